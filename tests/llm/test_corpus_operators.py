"""The corpus operators against brute force on small tables with nulls, ties, repeats, long texts and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farspan.llm import components, exact_dedup, language_id, license_scan, line_dedup, media, ngram_jaccard, packing, sentencepiece_sampling, sharding, shingles, signatures, toxicity
from farspan.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_LINES string, kept string, c string, n int"


def table(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()) + str(r.randrange(60)) for _ in range(n))


LONG_LINE = "The same passage stands here, in many documents."


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base.split()
    near[60] = "other"
    far = base.split()
    far[::10] = ["x%d" % i for i in range(len(far[::10]))]
    out = [(1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, base.replace(" ", "\t ", 3)), (11, base.upper())]
    out += [(20 + i, f"{words(30, 50 + i)}\n  {LONG_LINE.upper() if i % 2 else LONG_LINE}\t\nshort\n{LONG_LINE}") for i in range(5)]
    out += [(40, words(60_000, 9)), (41, words(60_000, 9) + " end"), (42, "Ünïcode čeština 中文 don't <|endoftext|> ½"), (12, words(40, 12)), (12, words(40, 12)), (None, base), (None, None)]
    return out + [(100 + i, words(80, i % 7 + 100)) for i in range(30)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark, rows):
    got = exact_dedup.find_groups(table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = collections.Counter((i, min((x for x in v if x is not None), default=None), len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.find_groups(table(spark, [])).count() == 0


def test_fingerprints_compose_and_unlike_texts_with_one_fingerprint_part(spark, monkeypatch):
    a, b = b"x" * 10_000, bytes(range(1, 200)) * 41
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b)) == exact_dedup.fingerprint(a + b)
    naive = lambda t, p, base: sum((c + 1) * pow(base, len(t) - 1 - i, p) for i, c in enumerate(t)) % p
    assert exact_dedup.fingerprint(b)[1:] == tuple(naive(b, p, q) for p, q in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True))


def test_lines(spark, rows):
    got = line_dedup.drop_repeated_lines(table(spark, rows)).collect()
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    bad = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) >= 3}
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) in bad and bad[key(x)] is not None and bad[key(x)] != i)]
        want[i, "\n".join(keep), len(lines), len(lines) - len(keep)] += 1
    assert collections.Counter((r.doc_id, r.text or "", r["n_lines_"], r.n_dropped) for r in got) == want
    assert [c for c in got[0].asDict() if c in SCHEMA] and got[0].N_LINES == "x"
    assert line_dedup.drop_repeated_lines(table(spark, [])).count() == 0


def test_columns_of_helpers_names_pass(spark):
    """Columns named like the operators' own helpers come through as they are."""
    names = ["_gone", "_gone_id", "_cut", "_Language", "_TOXICITY", "gone"]
    docs = spark.createDataFrame([(i, f"{LONG_LINE}\nown {i}", *"abcdef") for i in range(4)], ["doc_id", "text", *names])
    own = [tuple("abcdef")] * 4
    out = line_dedup.drop_repeated_lines(docs)
    assert [tuple(r[n] for n in names) for r in out.collect()] == own and out.agg(F.sum("n_dropped")).first()[0] == 3
    assert [tuple(r[n] for n in names) for r in language_id.identify(docs, None).collect()] == own
    assert [tuple(r[n] for n in names) for r in toxicity.with_score(docs, None).collect()] == own


def test_unlike_texts_with_one_fingerprint(spark, monkeypatch):
    """Where all fingerprints are equal, texts are still told apart, by their chunks and then their SHA-256."""
    def same(batches):
        for batch in exact_dedup_fingerprints(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([7] * n, pa.int64())] * 4, batch.column("sha")], batch.schema.names)

    exact_dedup_fingerprints = exact_dedup._fingerprints
    monkeypatch.setattr(exact_dedup, "_fingerprints", same)
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: (7, 7, 7))
    monkeypatch.setattr(exact_dedup, "key_of", lambda prints: np.full(len(prints), 7, np.int64).view(np.uint64))
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "other"), (4, "x" * 100_000), (5, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_groups(docs).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False)}


def brute_components(rows, size, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i].append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, rows, size, percent):
    got = ngram_jaccard.near_duplicates(table(spark, rows), size, percent).collect()
    want = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    by = {r.doc_id: r for r in got}
    assert by[6].n_shingles == 0 and by[8].n_shingles == 1 and by[8].component_id == by[9].component_id == 8
    assert ngram_jaccard.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_drifting_copies(spark):
    """Chains of near copies, where only neighbours link, and a doc_id with two texts."""
    base = words(200, 3).split()
    rows = []
    for i in range(25):
        base = [*base]
        base[(i * 37) % 200] = f"drift{i}"
        rows.append((i, " ".join(base)))
    rows.append((3, words(50, 77)))
    rows.append((90, words(50, 77)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicates(table(spark, rows), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_links_are_all_counted(spark, monkeypatch):
    """Every link between different texts counts, over several blocks and products, and in the query's own columns."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_BYTES", ngram_jaccard.LEAST_BYTES * 7)
    base = words(200, 3).split()
    rows = []
    for i in range(30):
        mine = [*base]
        mine[(i * 37) % 200] = f"own{i}"
        mine[(i * 53) % 200] = f"more{i}"
        rows.append((i, " ".join(mine)))
    rows += [(i, words(90, 40 + i)) for i in range(30, 34)] + [(50, rows[4][1])]
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: len({frozenset(b) for b in sets.values() if b != a and 100 * len(a & b) >= 85 * len(a | b)}) for i, a in sets.items()}
    got = {r.doc_id: r.n_links for r in ngram_jaccard.near_duplicates(table(spark, rows), 4, 85).collect()}
    assert got == want and max(want.values()) > 10
    assert "n_links" not in ngram_jaccard.near_duplicates(table(spark, rows), 4, 85, count_links=False).columns


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 7)
    r = np.random.default_rng(6)
    x = [np.unique(r.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 40, 100)]
    assert ngram_jaccard.shared_counts(x[:2], x).tolist() == [[len(np.intersect1d(a, b)) for b in x] for a in x[:2]]


def tuples(text, size):
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_comparison_word_by_word(monkeypatch):
    """Verdicts equal those on sets of word tuples, whatever is forgotten between them; unlike words with one hash don't count."""
    texts = [words(n, s).encode() for n in (0, 1, 3, 4, 40, 300) for s in (1, 2)] + [b"a b c", b"A  B\tC"]
    texts += [b" ".join([*t.split()[:k], b"new", *t.split()[k:]]) for t in texts for k in (0, 20)]
    sets = [tuples(t, 4) for t in texts]
    monkeypatch.setattr(ngram_jaccard, "HELD_BYTES", 3000)
    ready = ngram_jaccard.Prepared(4, 85)
    for a, p in zip(texts, sets, strict=True):
        for b, q in zip(texts, sets, strict=True):
            assert ready.near(a, b) == bool(p and q and 100 * len(p & q) >= 85 * len(p | q))
    monkeypatch.setattr(ngram_jaccard, "of_text", lambda text, size: np.arange(max(0, len(text.split()) - 3)).astype(np.uint64))  # all first shingles share a hash, all second ones...
    same = ngram_jaccard.Prepared(4, 85)
    left, right = b"one two left three four five", b"one two right three four five"
    assert not same.near(left, right) and same.near(left, left)
    a, b, c = ngram_jaccard.exact_sets([left, right, left], 4)
    assert a.tolist() == c.tolist() and not set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("block", [1, 64, 1 << 20])
def test_shingles_of_batches(monkeypatch, block):
    """Sets as large as those of word tuples, equal just where these are, whatever the blocks."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = [None, "", "  \n", "one", "One two", "a b c d e f a b c d", "x" * 2000 + " y " + "x" * 2000, "Ü é\x0b中文\x1fq z", "AB", " AB", *("a" * k for k in (7, 8, 9, 16, 17, 600))] + [words(n, n) for n in range(40)]
    for size in (1, 4, 5):
        got = [h[a:b].tolist() for _, h, o in shingles.of_batch(pa.array(["cut off", *texts])[1:], size) for a, b in zip(o[:-1], o[1:], strict=True)]
        sets = [tuples((t or "").encode(), size) for t in texts]
        assert [len(g) for g in got] == [len(x) for x in sets]
        for g, x, t in zip(got, sets, texts, strict=True):
            assert sorted(set(shingles.of_text((t or "").encode(), size).tolist())) == g
            assert all((g == h) == (x == y) for h, y in zip(got, sets, strict=True))


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_shards(spark, rows):
    got = sharding.assign_shards(table(spark, rows), 8).collect()

    def jump(k, n):
        k, b, j = k % 2**64, -1, 0
        while j < n:
            b, k = j, (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((k >> 33) + 1)))
        return b

    keys = {r.doc_id: r.k for r in table(spark, rows).select("doc_id", F.xxhash64(F.col("doc_id")).alias("k")).collect()}
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(keys[r.doc_id], 8), jump(keys[r.doc_id], 9))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.assign_shards(table(spark, [])).count() == 0


def test_licenses(spark, rows):
    extra = [(200, "Released under the MIT License. CC BY cc-by CC BY-SA 4.0"), (201, "GNU General Public License, version 3 or later; gnu general public license"), (202, "SPDX-License-Identifier: Apache-2.0"), (203, "emit license mitlicense"), (204, "Apache License, Version 2.0\n" * 300), (205, "BSD 3-Clause License. All rights reserved.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, rows + extra)).where("doc_id is not null").collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows + extra:
        if i is None:
            continue
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + p.count(" ") + 1] == p.split()]
        r = got[i]
        places = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[202].labels == "apache-2.0" and "cc-by-sa-4.0" in got[200].labels and "gpl-3.0" in got[201].labels
    assert "bsd-3-clause" in got[205].labels and got[203].labels == "" and got[5].score == 0
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


def spelled(pattern, r):
    """A random text that the pattern matches."""

    def walk(parts):
        out = ""
        for op, arg in parts:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                how, one = r.choice(arg)
                out += chr(one) if str(how) == "LITERAL" else chr(r.randint(*one))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(walk(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3))))
            elif kind == "SUBPATTERN":
                out += walk(arg[3])
            elif kind == "BRANCH":
                out += walk(r.choice(arg[1]))
            else:
                assert kind == "ANY"
                out += "x"
        return out

    return walk(re._parser.parse(pattern))


def found_by_rules(text):
    """Detections by plain re: every rule on the whole text, then suppression of what lies within a better one."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    every = {(r.label, r.priority, m.start(), m.end()) for r in signatures.rules() for m in re.finditer(f" {r.pattern}(?= )", w)}
    better = lambda d, e: e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2]))
    return {d for d in every if not any(better(d, e) for e in every)}


def test_license_rules_against_plain_python(spark, rows):
    """Gates and keywords hide nothing: detections equal those of every rule run on every text."""
    r = random.Random(8)
    texts = [" ".join([words(5, k), spelled(rule.pattern, r), words(3, k), spelled(r.choice(signatures.rules()).pattern, r)]) for k, rule in enumerate(signatures.rules())]
    texts += ["SPDX-License-Identifier: GPL-2.0-only", "under the terms of the GNU Lesser General Public License, version 3", "CC BY-SA 4.0 and CC BY 4.0", "simple example: replace", "mIT LIcense \u212a \u0130", "GPLv3; GPLv3, gplv3"]
    table_ = table(spark, [*enumerate(texts), *((1000 + k, t) for k, (_, t) in enumerate(rows))])
    got = {x.doc_id: x for x in license_scan.scan_licenses(table_).collect()}
    seen = collections.Counter()
    for i, t in [*enumerate(texts), *((1000 + k, t) for k, (_, t) in enumerate(rows))]:
        want = found_by_rules(t or "")
        assert {(d.label, d.priority, d.start, d.stop) for d in got[i].detections or []} == want, t
        seen.update(d[0] for d in want)
    assert len(seen) > 100 and len(signatures.rules()) > 300
    for rule in signatures.rules():  # so no match lacks its keyword or a gate
        for own in (f" {spelled(rule.pattern, r)} " for _ in range(40)):
            assert rule.keyword in own and any(g in f" {rule.keyword} " for g in signatures.GATES), own


def test_packing(spark, rows):
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(table(spark, rows), path).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in rows:
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(w, w[1:])) and sum(x[1] for x in w) <= 2048
    for i, ids in want:
        if want[i, ids] == 1 and sum(1 for k in want if k[0] == i) == 1:
            own = sorted(pieces[i])
            assert sum((p[1] for p in own), []) == list(ids) and {p[2] for p in own} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack_documents(table(spark, []), path).count() == 0


def test_differencing_balances_and_the_window_count_rises():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 512, 900)
    window = packing.pack(sizes, 2048)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 2048 and len(sums) <= math.ceil(sizes.sum() / 2048) + 2
    assert packing.pack(np.array([1500, 1500, 1000]), 2048).max() == 2  # two windows would hold 4000, but not these
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


SENTENCES = {"en": "the quick brown fox and the lazy dog were walking with them", "fr": "le chat et la souris étaient dans les jardins avec eux", "de": "der schnelle fuchs und die katze waren nicht mit ihnen"}


def test_language(spark, rows):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(SENTENCES[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(sorted(SENTENCES) * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.learn(df, F.lit(True))
    out = language_id.identify(df, model).collect()
    assert sum(x["_language"].lang_pred == x.lang for x in out) >= 0.98 * len(out)
    odd = language_id.identify(table(spark, [*rows, (300, "123 !?"), (301, "中文")]), model).select("doc_id", "_language.*").collect()
    by = {x.doc_id: x for x in odd}
    assert by[5].lang_pred == by[6].lang_pred == by[300].lang_pred == "und" and by[301].lang_pred in SENTENCES
    assert all(0 <= x.score <= 1 for x in odd) and len(odd) == len(rows) + 2
    none = language_id.learn(df.where("false"), F.lit(True))
    assert none is None and {x["_language"].lang_pred for x in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(table(spark, []), model).count() == 0


def test_code_words_correct_errors():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, None, np.full(15, 1 / 15), 6.0)
    for i in range(4):
        wrong = code[i].copy()
        wrong[[0, 5]] *= -1
        assert language_id.decode(wrong, model)[0] == i


def test_toxicity_learns_interactions(spark, rows):
    """Toxic only where an insult meets a group: no additive weights tell these apart."""
    r = random.Random(6)
    docs, labels = [], []
    for i in range(1200):
        insult, group = r.random() < 0.5, r.random() < 0.5
        t = [r.choice("red green blue sun moon".split()) for _ in range(6)] + ["wretch"] * insult + ["lowlanders"] * group
        r.shuffle(t)
        docs.append((i, " ".join(t)))
        labels.append((i, int(insult and group)))
    df, lab = table(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, lab, F.col("doc_id") % 5 != 0)
    out = {x.doc_id: x["_toxicity"] for x in toxicity.with_score(df, model).collect()}
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum((out[i] >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    odd = toxicity.with_score(table(spark, rows), model).collect()
    assert len(odd) == len(rows) and all(0 <= x["_toxicity"] <= 1 for x in odd)
    assert toxicity.learn(df, lab.where("false"), F.lit(True)) is None
    assert {x["_toxicity"] for x in toxicity.with_score(df, None).collect()} == {0.0}
    assert toxicity.with_score(table(spark, []), model).count() == 0


def test_media(spark):
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(60)] + [(60, None)], "vec_id long, embedding array<double>")
    pictures = media.pictures_of(vectors).union(spark.createDataFrame([(61, bytearray(b"junk")), (62, None), (None, bytearray(media.write_pgm(np.zeros((64, 64)))))], "id long, picture binary"))
    queries = media.pictures_of(vectors.where("vec_id % 3 = 0"), edited=True)
    got = media.find_copies(queries, pictures).collect()
    right = {x.query_id for x in got if x.query_id == x.match_id}
    assert len(right) >= 18 and sum(x.query_id != x.match_id for x in got) == 0  # of 20 planted copies
    assert media.find_copies(queries.where("false"), pictures).count() == 0


def pgm(*pictures):
    return [(i, bytearray(media.write_pgm(x))) for i, x in enumerate(pictures)]


def test_media_resized_turned_and_odd_crops(spark):
    r = np.random.default_rng(3)
    x = [media.draw(r.normal(size=16).tolist(), 160) for _ in range(6)]
    edits = [x[0][31:140, 17:121], media.resized(x[1], 2.0), media.resized(x[2], 1.4), media.turned(x[3], 0.6, 1.0), np.rot90(x[4]), media.turned(x[5], -2.0, 1.5)]
    got = media.find_copies(spark.createDataFrame(pgm(*edits), "id long, picture binary"), spark.createDataFrame(pgm(*x), "id long, picture binary")).collect()
    assert {(g.query_id, g.match_id) for g in got} == {(i, i) for i in range(6)}
    g = {g.query_id: g for g in got}
    assert (g[0].dy, g[0].dx, g[0].size, g[0].turn) == (31, 17, 1.0, 0)
    assert abs(g[1].size - 2) < 0.1 and abs(g[2].size - 1.4) < 0.1 and abs(abs(g[4].turn) - 90) < 3 and abs(g[5].size - 1 / 1.5) < 0.05


def test_media_small_crop_of_a_detailed_picture(spark):
    r = np.random.default_rng(4)
    x = np.kron(r.integers(0, 255, (100, 100)), np.ones((6, 6)))  # strong corners all over
    x[200:330, 200:330] = 110 + media.draw(r.normal(size=16).tolist(), 130) * 0.2
    got = media.find_copies(spark.createDataFrame(pgm(x[211:321, 209:323]), "id long, picture binary"), spark.createDataFrame(pgm(x), "id long, picture binary")).collect()
    assert [(g.query_id, g.match_id) for g in got] == [(0, 0)] and abs(got[0].dy - 211) <= 1 and abs(got[0].dx - 209) <= 1


def test_media_matches_are_no_rows_and_as_by_brute_force(spark, monkeypatch):
    """Pictures of plain shapes, alike in most corners: the copies of comparing all descriptors and voting on all pairs,
    without a join of descriptors, in blocks and pieces of any size. Rows that repeat an id vote together."""
    r = np.random.default_rng(7)
    x = [media.draw(r.normal(size=16).tolist()) for _ in range(24)]
    queries = [(100 + i, media.edit(x[i], i)) for i in range(12)] + [(100, x[20][:60, :60])]
    pictures = [(i, v) for i, v in enumerate(x)] + [(3, x[15]), (3, x[3])]
    want = set()
    q, p = (collections.defaultdict(list), collections.defaultdict(list))
    for to, rows_, how in ((q, queries, (media.QUERY_SCALES, 1)), (p, pictures, ())):
        for i, v in rows_:
            to[i] += media.describe(media.read_pgm(media.write_pgm(v)), *how)
    for i, a in q.items():
        for j, b in p.items():
            words = [np.array([d[4:] for d in v], np.int64).view(np.uint64) for v in (a, b)]
            differ = words[0][:, None] ^ words[1][None]
            near = (np.bitwise_count(differ).sum(axis=2) <= media.MAX_BITS_OFF) & (np.ascontiguousarray(differ).view(np.uint32) == 0).any(axis=2)
            m = sorted({(*(a[k][c] for c in (1, 2, 0, 3)), *(b[n][c] for c in (1, 2, 0, 3))) for k, n in np.argwhere(near).tolist()})
            votes, dy, dx, size, turn = media.agreement(np.array(m, float).reshape(-1, 8))
            if votes >= media.MIN_VOTES + (abs(size * np.exp(1j * np.radians(turn)) - 1) > 0.05):
                want.add((i, j, votes, round(size, 2)))
    monkeypatch.setattr(media, "QUERY_BLOCK", 700)
    monkeypatch.setattr(media, "PICTURE_BLOCK", 200)
    monkeypatch.setattr(media, "PIECE", 1000)
    frames = [spark.createDataFrame([(i, bytearray(media.write_pgm(v))) for i, v in rows_], "id long, picture binary") for rows_ in (queries, pictures)]
    out = media.find_copies(*frames)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert {(g.query_id, g.match_id, g.votes, g.size) for g in out.collect()} == want and len(want) >= 10


def ids_in(x):
    return tuple(np.frombuffer(x, "<i4").tolist())


def test_sentencepiece(spark, rows):
    """Whole texts, very long ones and one without blanks among them, decode to themselves; segmentations are distinct."""
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [*rows, (500, "a▁b  two  spaces\n🙂"), (501, "unbrokenstringofletters" * 300)]
    got = sentencepiece_sampling.sample_segmentations(table(spark, texts), ["doc_id"], path, 3)
    out = got.withColumn("back", sentencepiece_sampling.decode_ids(F.col("ids"), path)).collect()
    want, found = collections.defaultdict(set), collections.defaultdict(list)
    for i, t in texts:
        want[i].add(t or "")
    for x in out:
        assert x.exact and x.back in want[x.doc_id] and 0 <= x.inclusion <= 1
        found[x.doc_id, x.back].append(ids_in(x.ids))
    assert set(found) == {(i, t or "") for i, t in texts}
    for i in (500, 501, 40):
        assert len(set(found[i, next(iter(want[i]))])) == 3
    assert sentencepiece_sampling.sample_segmentations(table(spark, []), ["doc_id"], path).count() == 0
    with pytest.raises(ValueError, match="rank"):
        sentencepiece_sampling.sample_segmentations(table(spark, rows).withColumn("rank", F.lit(1)), ["RANK"], path)


def every_segmentation(text, lattices):
    """Plain enumeration of all ways through the text: ids to probability."""
    t, out, done = " " + text, [((), 0.0, 0)], {}
    while out:
        ids, w, i = out.pop()
        if i == len(t):
            done[ids] = math.exp(w)
            continue
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in lattices.pieces:
                piece, weight = lattices.pieces[t[i:j]]
                out.append((ids + ids_in(piece), w + weight, j))
        if t[i] not in lattices.pieces:
            own = tuple(lattices.bytes[b] for b in t[i].encode())
            out.append((ids + own, w - sentencepiece_sampling.POWER * 12 * len(own), i + 1))
    total = sum(done.values())
    return {ids: p / total for ids, p in done.items()}


@pytest.mark.parametrize("text", ["ab", "the\ncat", "a bé", "in it"])
@pytest.mark.parametrize("whole", [0, 32])
def test_sampling_laws(monkeypatch, text, whole):
    """Against all segmentations enumerated: first and second draws without replacement, and inclusion scores. Whether
    units are walked place by place or chosen whole makes no difference, nor what is forgotten."""
    monkeypatch.setattr(sentencepiece_sampling, "WHOLE", whole)
    monkeypatch.setattr(sentencepiece_sampling, "HELD_UNIT", 3)
    lattices, n = sentencepiece_sampling.Lattices(tokenizer_path("piece_bpe_32k.model")), 3000
    p = every_segmentation(text, lattices)
    first, second, weight = collections.Counter(), collections.Counter(), collections.Counter()
    for seed in range(n):
        out = [(ids_in(ids), logp, score) for ids, logp, score in sentencepiece_sampling.sample(text, 3, seed * 7919, lattices)]
        assert len({ids for ids, _, _ in out}) == min(3, len(p))
        for ids, logp, score in out:
            assert abs(math.exp(logp) - p[ids]) < 1e-9
            weight[ids] += 1 / score
        first[out[0][0]] += 1
        second[out[1][0]] += 1
    for ids in sorted(p, key=p.get)[-4:]:
        assert abs(first[ids] / n - p[ids]) < 0.03
        assert abs(second[ids] / n - sum(p[x] * p[ids] / (1 - p[x]) for x in p if x != ids)) < 0.03
        assert p[ids] < 0.05 or abs(weight[ids] / n - 1) < 0.12
