"""The pipeline's stages, each on its predecessor's output."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("basalt.llm.queries")
import corpus_pipeline as P

from basalt.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before and len(after) > 0.5 * len(before)
        before = after
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [decontaminate.normalise(r.text) for r in docs.collect()]
    assert not any(decontaminate.normalise(t) in x for _, t in items for x in texts)
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == before
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "packing"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = docs.selectExpr("doc_id + 900 as doc_id", "cast(null as string) text", "lang", "source", "n_chars").union(docs).union(docs).union(docs.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    for _, stage in P.STAGES:
        odd.write.mode("overwrite").parquet(str(tmp_path / "in"))
        frame = spark.read.parquet(str(tmp_path / "in"))
        odd = spark.createDataFrame(stage(spark, frame, SF).toPandas()) if stage is P.pack else spark.createDataFrame(stage(spark, frame, SF).collect(), frame.schema)
    assert odd.count() > 0


def test_language_stage_against_a_plain_model(spark):
    """The stage drops what a naive Bayes model over letter triples, counted in plain Python, calls no language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    junk = [(10**6 + i, " ".join("".join(rng.choice("#$%&0123456789+=<>|~^") for _ in range(6)) for _ in range(60)), "en", "src1", 1) for i in range(12)]
    frame = docs.union(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in P.language(spark, frame, SF).collect()}
    triples = lambda t: [w for w in zip(t, t[1:], t[2:]) if any(c.isalpha() for c in w)]
    rows = [(r.doc_id, (r.text or "").lower(), r.lang) for r in frame.collect()]
    counts = {}
    for d, t, lang in rows:
        if d < 10**6:
            counts.setdefault(lang, Counter()).update(triples(t))
    total, size = {k: sum(c.values()) for k, c in counts.items()}, 30_000
    for d, t, lang in rows:
        mine = triples(t)
        best = max((sum(math.log((c[w] + 0.5) / (total[k] + size / 2)) for w in mine) for k, c in counts.items()), default=0)
        none = -math.log(size) * len(mine)
        if not mine or d >= 10**6:
            assert d not in kept
        elif best > none + 5:
            assert d in kept, (d, t[:80])


def test_line_stage_against_brute_force(spark):
    """The stage's texts are those of a plain all-pairs comparison of normalised lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randrange(4, 9)))
    pool = [[word() for _ in range(n)] for n in (3, 4, 5, 7, 8, 9, 12, 18, 26, 33, 40, 70) for _ in range(4)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(pool)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.5 and len(w) > 8:
                i = rng.randrange(len(w))
                w[i] = w[i][:-1] + "z"
            out.append(" ".join(w) + rng.choice(["", ".", "  !"]))
        rows.append((d, "\n".join(out), "en", "s", 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.lines(spark, frame, SF).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    spots = [(d, i, norm(t)) for d, text, *_ in rows for i, t in enumerate(text.split("\n")) if len(norm(t).split()) >= 3]
    lines = sorted({n for _, _, n in spots})
    group = {n: n for n in lines}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = int(max(len(a), len(b)) * 0.1 + 1e-9)
            if abs(len(a) - len(b)) <= most and root(a) != root(b) and edits(a, b) <= most:
                group[root(a)] = root(b)
    stays, gone = set(), set()
    for d, i, n in sorted(spots):
        (gone if root(n) in stays else stays).add((d, i) if root(n) in stays else root(n))
    want = {}
    for d, text, *_ in rows:
        left = [t for i, t in enumerate(text.split("\n")) if (d, i) not in gone]
        if any(len(norm(t).split()) >= 3 for t in left) or not any((d, i) in gone for i in range(9)):
            want[d] = "\n".join(left)
    assert got == want and len(gone) > 40


def test_stages_on_empty_tables_and_odd_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
    wide = docs.limit(30).selectExpr("*", "1 as removed", "2 as emptied", "'x' as _gone_id", "3 as kept", "4 as `a.b`", "5 as accepted")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and {(r.removed, r.emptied, r._gone_id, r["a.b"]) for r in out.collect()} == {(1, 2, "x", 4)}
