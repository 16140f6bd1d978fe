"""The pipeline's stages against plain Python: what each keeps, cuts and packs of its own input."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LONG_LINE, brute_components, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from farspan.llm import language_id, toxicity  # noqa: E402
from farspan.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Names that stages use for columns of their own.
CLASHING = ["_gone", "_cut", "_Language", "_TOXICITY", "gone", "n_lines", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents of SF, with nulls, empty, very long, repeated and letterless texts, and clashing columns."""
    base = words(60, 4)
    odd = [(None, base), (None, None), (900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "123 !?"), (900_005, words(30_000, 8)), (900_006, base), (900_007, base), (900_007, base), (900_008, "x" * 200_000)]
    odd += [(900_010 + i, f"{words(20, 200 + i)}\n{LONG_LINE}") for i in range(4)]
    odd += [(900_020, words(50, 5)), (900_021, words(50, 5).upper().replace(" ", "\t"))]
    own = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in own.dtypes if c not in ("doc_id", "text")})
    more = more.withColumn("n_chars", F.length("text").cast(dict(own.dtypes)["n_chars"])).select(*own.columns)
    both = own.unionByName(more)
    return both.select("*", *(F.lit(c).alias(c) for c in CLASHING)).cache()


def plain_toxicity(text, model):
    """Bias, weights and every pair of factors, added up one by one."""
    seen = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for w in [word, *(word[:k] + "-" for k in (4, 5, 6, 7) if len(word) > k)]:
            seen[zlib.crc32(w.encode()) % 2**20] += 1
    at = [model.index[h + 2**20 * i] for h, n in seen.items() for i in range(min(n, 3)) if h + 2**20 * i in model.index]
    z = model.bias + sum(model.linear[i] for i in at)
    z += sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(at) for b in at[:k])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_language(text, model):
    """(language, score): each trigram counted by itself, each codeword's loss by its definition."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    folded = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b" "
    counts = collections.Counter()
    for i in range(len(folded) - 2):
        a, b, c = folded[i : i + 3]
        if not a == b == 32:
            counts[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20] += 1
    counts.pop(0, None)
    norm = math.sqrt(sum(counts.values())) or 1.0
    margins = model.weights[-1].copy()
    for h, n in counts.items():
        margins += math.sqrt(n) / norm * model.weights[h]
    loss = [sum(t * max(0.0, 1 - c * m) for t, c, m in zip(model.trust, code, margins, strict=True)) for code in model.codes]
    weight = [math.exp(-model.sharp * (x - min(loss))) for x in loss]
    best = max(range(len(loss)), key=lambda i: (weight[i], -i))
    p = sorted((w / sum(weight) for w in weight), reverse=True)
    return model.languages[best], weight[best] / sum(weight), len(p) > 1 and p[0] - p[1] < 0.1


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_against_plain_python(spark, docs):
    columns, types = docs.columns, docs.dtypes
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "line_dedup", "ngram_jaccard", "packing"]

    def run(name, before):
        out = stages[name](spark, before, SF).cache()
        assert out.columns == columns and out.dtypes == types
        assert all(tuple(r) == tuple(CLASHING) for r in out.select(*CLASHING).distinct().collect())
        return out

    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    scores = {t: plain_toxicity(t, model) for _, t in kept(docs)}
    calm = run("toxicity", docs)
    assert all(abs(x - 0.5) > 1e-6 for x in scores.values())
    assert kept(calm) == collections.Counter({k: n for k, n in kept(docs).items() if scores[k[1]] < 0.5})
    assert 0 < docs.count() - calm.count() < 0.2 * docs.count()

    model = language_id.learn(calm, F.lit(True))
    found = {t: plain_language(t, model) for _, t in kept(calm)}
    told = run("language_id", calm)
    stays = {t: f[0] != "und" and not (f[2] and f[1] < 0.5) for t, f in found.items()}
    assert kept(told) == collections.Counter({k: n for k, n in kept(calm).items() if stays[k[1]]})
    assert not {900_001, 900_002, 900_003, 900_004} & {i for i, _ in kept(told)}

    held = collections.defaultdict(list)
    before = [(r.doc_id, r.text, r.n_chars) for r in told.collect()]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    for i, t, _ in before:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                held[k].append(-1 if i is None else i)
    bad = {k: max(v) for k, v in held.items() if len(v) >= 3 and max(v) >= 0}
    cut = run("line_dedup", told)
    want = collections.Counter()
    for i, t, _ in before:
        t = "\n".join(x for x in t.split("\n") if bad.get(key(x), i) == i)
        want[i, t, len(t)] += 1
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == want and bad

    rows = [(i, t) for (i, t), n in kept(cut).items() for _ in range(n)]
    first = brute_components(rows, 5, 80)
    unlike = run("ngram_jaccard", cut)
    assert kept(unlike) == collections.Counter((i, t) for i, t in rows if i is None or first[i] == i)
    assert first[900_020] == first[900_021] == 900_020 and first[900_007] == 900_007

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for (i, t), n in kept(unlike).items() for _ in range(n))
    packed = stages["packing"](spark, unlike, SF).collect()
    assert sum(r.length for r in packed) == sum(len(ids) * n for (_, ids), n in want.items())
    pieces = collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    ids_of = collections.Counter(i for (i, _), n in want.items() for _ in range(n))
    for (i, ids), _ in want.items():
        if ids_of[i] == 1:
            assert sum((p for _, p in sorted(pieces[i])), []) == list(ids)
    assert set(pieces) == set(ids_of)


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), SF)
        assert out.count() == 0 and (name == "packing" or out.dtypes == docs.dtypes), name


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (2, None, None), (3, "", None)], "doc_id long, text string, lang string")
    assert kept(corpus_pipeline.keep_languages(spark, docs, SF)) == kept(docs)
    assert kept(corpus_pipeline.drop_toxic(spark, docs.withColumn("doc_id", -F.col("doc_id")), SF)) == kept(docs.withColumn("doc_id", -F.col("doc_id")))
