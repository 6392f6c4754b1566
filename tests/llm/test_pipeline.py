"""The pipeline, stage by stage, against brute force over a whole small table, and its edge cases."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_edges import LONG, TEXT
from varloom.llm import linededup, quality, registry, simhash
from varloom.llm.common import table
from varloom.llm.decontam import normal

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def shingles(text):
    words = [w for w in text.encode().lower().split()]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept_of(texts, similarity=0.8):
    """The ids that stay if all texts whose shingle sets are that similar are linked; every pair that shares a shingle is met."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent, holders, empty = {d: d for d in sets}, defaultdict(list), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        p, q = sorted((root(a), root(b)))
        parent[q] = p

    for d in sorted(sets):
        common = defaultdict(int)
        for s in sets[d]:
            for other in holders[s]:
                common[other] += 1
            holders[s].append(d)
        for other, n in common.items():
            if n / (len(sets[d]) + len(sets[other]) - n) >= similarity:
                link(d, other)
        if not sets[d]:
            empty.append(d)
    for d in empty:
        link(d, empty[0])
    return {root(d) for d in sets}


def test_stages(spark):
    documents = table(spark, SF, "documents")
    columns, kept = documents.columns, {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), None if name == "best-fit packing" else documents.schema)
        kept[name] = docs.toPandas()
        assert docs.columns == columns or name == "best-fit packing"
    first = documents.toPandas()

    trees = quality.fit(documents, table(spark, SF, "labels"))
    good = [d for d, t in zip(first["doc_id"], first["text"], strict=True) if trees.score(quality.statistics(t)[None, :])[0] >= 0.5]
    own = kept["quality classifier"]
    assert sorted(own["doc_id"]) == sorted(good) and len(good) < len(first)

    sites, texts = defaultdict(set), defaultdict(set)
    for t, s in zip(own["text"], own["source"], strict=True):
        for x in t.split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                texts[x.strip(" ")].add(t)
    lines = kept["line dedup"].set_index("doc_id")["text"]
    for d, t in zip(own["doc_id"], own["text"], strict=True):
        assert lines[d] == "\n".join(x for x in t.split("\n") if min(len(sites[x.strip(" ")]), len(texts[x.strip(" ")])) < linededup.SITES)
    own = kept["line dedup"]
    assert (own["n_chars"] == own["text"].str.len()).all()

    stays = kept["near-dedup"]
    assert set(stays["doc_id"]) == kept_of(dict(zip(own["doc_id"], own["text"], strict=True))) and len(stays) < len(own)

    items = [normal(t) for t in table(spark, SF, "benchmark").toPandas()["text"]]
    leaks = {d for d, t in zip(stays["doc_id"], stays["text"], strict=True) if any(len(c) >= 40 and c in normal(t) for c in items)}
    clean = kept["decontamination"]
    assert leaks and set(clean["doc_id"]) == set(stays["doc_id"]) - leaks

    library = Tokenizer.from_file(registry.tokenizer())
    packed = kept["best-fit packing"]
    assert set(packed["doc_id"]) == set(clean["doc_id"])
    tokens = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in clean["text"])
    fill = packed.groupby("sequence_id")["length"].sum()
    assert packed["length"].sum() == tokens and fill.max() <= 4096 and len(fill) <= np.ceil(tokens / 4096) + 1


def test_near_dedup_of_a_larger_table(spark):
    """No document goes without a partner, and no pair of similarity 0.8 is lost."""
    docs = table(spark, SF2, "documents").where("text IS NOT NULL")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF2).collect()}
    assert kept == kept_of(texts) and len(kept) < len(texts)


def test_candidates_reach_beyond_the_threshold():
    """Of thousands of pairs just over 0.8, all lie within the candidates' radius."""
    rng, lost, pairs = np.random.default_rng(5), 0, 3000
    radius = simhash.candidate_radius(0.8, 4)
    for _ in range(pairs):
        n = int(rng.integers(20, 400))
        moved = int(n / 9)  # n - m shared of n + m: over 0.8
        both = rng.integers(0, 1 << 63, n + moved, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n + moved, dtype=np.uint64)
        a, b = (np.array(simhash.mixed(np.unique(x), 4), np.int64).view(np.uint64) for x in (both[:n], both[moved:]))
        lost += int(np.bitwise_count(a ^ b).sum()) > radius
    assert lost <= pairs // 1000


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count() > 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, ties, long and empty texts, and columns that stages use too."""
    at = str(tmp_path_factory.mktemp("odd"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_lines string, _kept long, mine long, id string"
    more = ("a", "b", "c", 7, 8, "d")
    texts = [(1, TEXT), (1, TEXT), (1, TEXT + " more"), (2, TEXT), (None, TEXT), (None, None), (3, None), (4, ""), (4, ""), (5, " \n "), (6, LONG), (7, "one"), (8, "one")]
    rows = [(d, t, "en", None if d == 2 else f"s{k}", None, *more) for k, (d, t) in enumerate(texts)]
    spark.createDataFrame(rows, kind).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "an item that no document holds, of forty characters"), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_edges_of_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, folder)
            if name == "best-fit packing":
                assert out.where("piece = 0").count() == given.count()
                continue
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= given.count()
            assert {tuple(r) for r in out.select("score", "predicted", "n_lines", "_kept", "mine", "id").collect()} <= {("a", "b", "c", 7, 8, "d")}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).select("doc_id", "text").collect()
    ids = sorted((r["doc_id"] for r in kept if r["doc_id"] is not None))
    assert ids == [1, 3, 6, 7] and corpus_pipeline.run(spark, folder).count() >= 0


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
