"""The registered queries against their contracts, said again in plain Python: columns, folds and every digest."""

import collections
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, words

from farspan.llm import license_scan, queries

SF = "/root/testdata/sf0.001"


def remainder(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of SF with odd documents more, every id once."""
    at = tmp_path_factory.mktemp("sf")
    odd = [(900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "123 !?"), (900_005, words(20_000, 8)), (900_006, "x" * 100_000), (900_007, "MIT License\ncc by, Apache License; mit license")]
    odd += [(900_010 + i, words(40, 3)) for i in range(4)]
    own = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in own.dtypes if c not in ("doc_id", "text")})
    own.unionByName(more).withColumn("held_out", F.lit("clash")).coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def by_id(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    assert set(out) == set(rows)
    return out


def test_language_learns_from_its_folds_alone(spark, folder, rows, tmp_path):
    df = queries.op1_language_id(spark, folder)
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(df.columns)
    got = by_id(df, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = {i for i in rows if remainder(i, 3) == 1}
    assert {i for i, r in got.items() if r.held_out} == held
    learned = {lang[i] for i in rows if i not in held and lang[i]}
    for i, r in got.items():
        letters = any(c.isalpha() for c in rows[i] or "")
        assert (r.lang_pred in learned) if letters else (r.lang_pred == "und"), i
        assert 0 <= r.score <= 1
    told = [i for i in held if lang[i]]
    assert sum(got[i].lang_pred == lang[i] for i in told) >= 0.9 * len(told) > 0
    spoilt = docs.withColumn("lang", F.when(queries.fold(3) == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    spoilt.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    again = by_id(queries.op1_language_id(spark, str(tmp_path)), rows)
    assert all(again[i].lang_pred == r.lang_pred and abs(again[i].score - r.score) < 1e-4 for i, r in got.items())


def test_toxicity_learns_from_its_folds_alone(spark, folder, rows, tmp_path):
    df = queries.op7_toxicity(spark, folder)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    got = by_id(df, rows)
    for i, r in got.items():
        assert r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    spark.read.parquet(f"{folder}/documents.parquet").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.withColumn("toxic", F.when(queries.fold(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    again = by_id(queries.op7_toxicity(spark, str(tmp_path)), rows)
    assert all(abs(again[i].score - r.score) < 1e-4 for i, r in got.items())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_exact_dedup"])
def test_queries_with_sql(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    want = db.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(tuple(r[k] for k in order) for r in want.fetchall())


def test_packing_contract(spark, folder, rows):
    from tokenizers import Tokenizer

    got = queries.op3_packing(spark, folder).collect()
    tok = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(rows)
    for i, own in pieces.items():
        ids = tok.encode(rows[i] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_jaccard_contract(spark, folder, rows):
    df = queries.op4_ngram_jaccard(spark, folder)
    got = by_id(df, rows)
    want = brute_components(list(rows.items()), 4, 85)
    for i, r in got.items():
        w = (rows[i] or "").encode().lower().split()
        own = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        assert (r.n_shingles, r.component_id) == (len(own), want[i])


def test_licence_contract(spark, folder, rows):
    got = by_id(queries.op5_license_scan(spark, folder), rows)
    for i, r in got.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i] or ""))
        at = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + phrase.count(" ") + 1] == phrase.split()]
        places, base = [k for k, _ in at], sorted({x for _, x in at})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(base))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r.score <= 1


def test_sharding_contract(spark, folder, rows):
    got = by_id(queries.op9_sharding(spark, folder), rows)
    slots = collections.defaultdict(list)
    for i, r in got.items():
        t = (rows[i] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sampling_contract(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").limit(40)
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {(r.conv_id, r.turn): r.text for r in turns.collect()}
    got = collections.defaultdict(list)
    for r in queries.op10_sentencepiece(spark, str(tmp_path)).collect():
        got[r.conv_id, r.turn].append(r)
        assert r.exact and r.n_ids >= 0 and r.log_prob <= 1e-9 and 0 < r.inclusion <= 1 + 1e-9
    assert set(got) == set(want)
    for own in got.values():
        ranks = sorted(r["rank"] for r in own)
        assert ranks == list(range(ranks[0], ranks[0] + len(own))) and len(own) <= 3
