"""The pipeline against a brute-force version of all five stages, and its stages on odd rows."""

import hashlib
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from pixelwell.llm import quality_fm, queries
from pixelwell.llm.tokens import public_path

STAGE = dict(corpus_pipeline.STAGES)


def slow_quality(rows, machine):
    """Scores with the sum over all pairs of features."""
    kept = []
    for r in rows:
        idx, x = quality_fm.features(r.text, [r.n_chars])
        vx = machine.v[idx].astype(np.float64) * x[:, None]
        both = vx @ vx.T
        raw = machine.w0 + float((machine.w[idx].astype(np.float64) * x).sum()) + (both.sum() - np.trace(both)) / 2
        score = 1 / (1 + np.exp(-raw))
        fast = machine.score(idx, x)  # in single precision
        assert abs(score - fast) < 1e-5 and (score >= quality_fm.ACCEPT) == (fast >= quality_fm.ACCEPT)
        if score >= quality_fm.ACCEPT:
            kept.append((r.doc_id, r.text))
    return kept


def slow_lines(docs):
    """``docs``: (id, text), ids in order."""
    seen, out = set(), []
    for i, text in docs:
        if text is None:
            out.append((i, text))
            continue
        ls = text.split("\n")
        n = min(3, len(ls))
        gone = set()
        for at in range(len(ls) - n + 1):
            w = (n, *ls[at : at + n])
            if regex.search(r"[\p{L}\p{N}]", "\n".join(w[1:])):
                if w in seen:
                    gone.update(range(at, at + n))
                seen.add(w)
        new = "\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else text
        if not gone or new.strip(" \t\n\v\f\r"):
            out.append((i, new))
    return out


def slow_near(docs):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both) and group[a] != group[b]:
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
    return [d for k, d in enumerate(docs) if group[k] == k]


def slow_clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = []
    for i, text in docs:
        w, hit = words(text), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append((i, text))
    return out


def slow_encode(docs):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(public_path("word_bpe_49k.json")), []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """sf0.01, with copies of good documents: one exact, one near, one of which three lines come back, one with a benchmark item."""
    source, to = f"{sf}/../sf0.01", str(tmp_path_factory.mktemp("tables"))
    docs, bench = spark.read.parquet(f"{source}/documents.parquet"), spark.read.parquet(f"{source}/benchmark.parquet")
    good = docs.join(spark.read.parquet(f"{source}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    base = good.where("length(text) between 1500 and 6000").orderBy("doc_id").first()
    item = bench.where("size(split(text, ' ')) >= 20").orderBy("item_id").first()["text"]
    more = [base.text, base.text + " ending", "first\nsecond\nthird\n" + base.text[::-1], "first\nsecond\nthird\n" + base.text, base.text[:700] + " " + item, None, ""]
    rows = [(10**6 + k, t, base.lang, base.source, None if t is None else len(t)) for k, t in enumerate(more)]
    docs.unionAll(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{to}/documents.parquet")
    bench.write.parquet(f"{to}/benchmark.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return to


def test_pipeline_equals_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    machine = quality_fm.fit_quality(docs, labels, ~queries.held_out(4, 2), metadata=queries.METADATA)
    rows = docs.orderBy("doc_id").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    one = slow_quality(rows, machine)
    two = slow_lines(one)
    three = slow_near(two)
    four = slow_clean(three, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert len(rows) > len(one) > 0 and one != two and len(two) > len(three) > len(four) > 0
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(slow_encode(four))


def test_stages_on_odd_rows(spark, folder, tmp_path):
    words = [f"w{k}" for k in range(40)]
    a, b, c = " ".join(words), " ".join([*words, "end"]), " ".join(reversed(words))
    rows = [(1, a), (2, b), (3, c), (3, c), (4, a), (4, "only here " + c[:60]), (None, a), (5, None), (6, ""), (7, " \n ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], spark.read.parquet(f"{folder}/documents.parquet").schema)
    docs = docs.withColumn("fp", F.lit("mine")).withColumn("label", F.lit(None).cast("string"))
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    near = STAGE["near"](spark, docs, folder)
    # One row of each group stays, and one of equal rows.
    assert near.columns == docs.columns and key(near) == sorted([(1, a), (3, c), (4, "only here " + c[:60]), (5, None), (6, ""), (7, " \n ")], key=str)
    assert key(STAGE["lines"](spark, docs, folder)) == sorted((r for r in rows if r not in ((4, a), (None, a))), key=str)
    assert key(STAGE["decontaminate"](spark, docs, folder)) == sorted(rows, key=str)
    assert STAGE["encode"](spark, docs, folder).count() == len(rows) and STAGE["quality"](spark, docs, folder).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
