"""The stages of the pipeline, one by one and together, on awkward tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelyard.llm import decontamination, pieces, quality, secrets, training
from panelyard.llm.cases import PIECES
from tests.llm.helpers import COLUMNS, Groups, awkward_texts, documents, lowered, sentence, words_of

NAMES = [name for name, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)


def shingles(text):
    w = words_of(lowered(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    items = [sentence(rng, 25, 10**5) for _ in range(4)]
    rows = awkward_texts(rng)
    rows += [(300 + i, f"{sentence(rng, 30, 10**5)} {items[i % 4]} {sentence(rng, 30, 10**5)}") for i in range(8)]
    rows += [(320 + i, f"{sentence(rng, 40, 10**5)} token = Zx9{i}kQ2mW8vB4nT7 end") for i in range(5)] + [(330, "$$$ @@ " * 30)] * 2
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    texts, items = rows
    spark.createDataFrame([(i, int("$" not in (t or "")), 0) for i, t in texts if i is not None], "doc_id long, quality int, toxic int") \
        .dropDuplicates(["doc_id"]).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    documents(spark, texts, clashing=False).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_stage_on_nothing(spark, folder, name):
    empty = spark.createDataFrame([], COLUMNS)
    out = STAGE[name](spark, empty, folder)
    assert out.count() == 0 and (name == NAMES[-1] or out.columns == empty.columns)


@pytest.mark.parametrize("name", NAMES[:-1])
def test_stage_keeps_columns_of_any_name(spark, folder, rows, name):
    docs = documents(spark, rows[0]).withColumns({c: F.lit("own") for c in ("quality_score", "gone", "again", "clean", "spans_", "Spans2", "_spans")})
    out = STAGE[name](spark, docs, folder)
    assert out.columns == docs.columns
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert out.where(" or ".join(f"`{c}` <> 'own'" for c in own)).count() == 0


def plain_stage(spark, name, rows, folder):
    """(id, text) rows that stay, from the definition of the stage."""
    docs = documents(spark, rows, clashing=False)
    if name == "quality_classifier":
        labels = spark.read.parquet(f"{folder}/labels.parquet")
        model = training.fit(training.labelled_sample(docs, labels, "doc_id", "text", "quality", learn=training.remainder(F.col("doc_id"), 5) != 0),
                             quality.learn, quality.WIDTH)
        margin = quality.scorer()
        return Counter((i, t) for i, t in rows if 1 / (1 + 2.718281828459045 ** -(margin(t or "", model) + float(model[-1]))) >= corpus_pipeline.LEAST_QUALITY)
    if name == "jaccard_join":
        sets = [(i, t, shingles(t)) for i, t in rows]
        groups = Groups()
        for i, _, x in sets:
            for j, _, y in sets:
                if x and y and i is not None and j is not None and 100 * len(x & y) >= 80 * len(x | y):
                    groups.link(i, j)
        keep, taken = Counter(), set()
        for i, t, x in sorted(sets, key=lambda s: (s[0] is None, s[0] or 0, s[1] or "")):
            if i is None or not x:
                keep[i, t] += 1
            elif groups.find(i) == i and i not in taken:
                taken.add(i)
                keep[i, t] += 1
        return keep
    if name == "benchmark_decontamination":
        items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
        found = {t for _, t in rows if t and any(" ".join(words_of(item)) in " ".join(words_of(t)) for item in items)}
        return Counter((i, t) for i, t in rows if t not in found)
    raise AssertionError(name)


@pytest.mark.parametrize("name", ["quality_classifier", "jaccard_join", "benchmark_decontamination"])
def test_filtering_stages_match_plain_versions(spark, folder, rows, name):
    got = Counter((r.doc_id, r.text) for r in STAGE[name](spark, documents(spark, rows[0]), folder).collect())
    assert got == plain_stage(spark, name, rows[0], folder)


def test_secret_stage_marks_what_the_operator_finds(spark, folder, rows):
    docs = documents(spark, rows[0])
    spans = {(r.id, r.text): [(s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    out = STAGE["secret_scan"](spark, docs, folder).collect()
    assert len(out) == len(rows[0]) and sum("[secret]" in (r.text or "") for r in out) >= 5
    marked = Counter()
    for (i, t), found in spans.items():
        at, left = 0, ""
        for start, end in found:
            if start >= at:
                left += t[at:start] + "[secret]"
            at = max(at, end)
        marked[i, None if t is None else left + t[at:]] += Counter(rows[0])[i, t]
    assert Counter((r.doc_id, r.text) for r in out) == marked
    assert all(r.n_chars == len(r.text or "") for r in out)


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in NAMES[:-1]:
        docs = spark.createDataFrame(STAGE[name](spark, docs, folder).collect(), docs.schema)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    back = pieces.decode(out, pieces.model_bytes(PIECES)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == texts
    assert all((r.n_pieces is None) == (r.ids is None) and r.n_pieces == (None if r.ids is None else len(r.ids)) for r in back)
    assert decontamination.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
