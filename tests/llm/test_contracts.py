"""The registered queries over whole small tables, against brute force."""

import hashlib
import html
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from varloom.llm import decontam, extract, langid, quality, registry, spotsigs
from varloom.llm.common import held_out, table
from varloom.llm.decontam import normal

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def rows(table, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{table}.parquet'").df()


@pytest.fixture(scope="module")
def docs():
    return {int(d): t or "" for d, t in zip(rows("documents")["doc_id"], rows("documents")["text"], strict=True)}


def test_quality_held_out(spark):
    found = registry.op1_quality(spark, SF2).toPandas()
    truth = rows("labels", SF2).merge(found, on="doc_id")
    assert len(found) == len(rows("documents", SF2)) and found["score"].between(0, 1).all()
    held = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d in found["doc_id"]])
    assert (found["held_out"].to_numpy() == held).all()
    assert ((found["score"] >= 0.5).astype(int) == found["predicted"]).all()
    truth = truth[truth["held_out"]]
    assert (truth["predicted"] == truth["quality"]).mean() > 0.95


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer())
    sizes = np.array([len(library.encode(t, add_special_tokens=False).ids) for t in docs.values()])
    found = registry.op2_token_counts(spark, SF).toPandas().sort_values("n_tokens")
    assert found["n_docs"].sum() == len(docs) and (found["n_tokens"] * found["n_docs"]).sum() == sizes.sum()
    for r in found.itertuples():
        assert r.n_docs == (sizes == r.n_tokens).sum()
        assert r.docs_from == (sizes >= r.n_tokens).sum() and r.tokens_from == sizes[sizes >= r.n_tokens].sum()
        assert r.truncated_total == np.minimum(sizes, r.n_tokens).sum()
        assert r.quantile == pytest.approx((sizes <= r.n_tokens).mean())


def test_decontamination_finds_exact_passages(spark):
    documents, items = rows("documents", SF2), rows("benchmark", SF2)
    clean = {i: normal(t) for i, t in zip(items["item_id"], items["text"], strict=True)}
    exact = {(d, i) for d, t in zip(documents["doc_id"], documents["text"], strict=True) for i, c in clean.items() if len(c) >= 40 and c in normal(t)}
    found = registry.op3_decontamination(spark, SF2).toPandas()
    assert exact <= set(zip(found["doc_id"], found["item_id"], strict=True))
    assert len(exact) > 10 and len(found) <= len(exact) * 1.1 + 1


def edits_within(needle, text):
    """Fewest edits of the needle against any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(needle, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_with_edits(spark):
    """Passages of items with edits put into strange text: found exactly where the plain table says so."""
    import random

    r, items = random.Random(4), [(k, normal(t)) for k, t in zip(rows("benchmark", SF2)["item_id"], rows("benchmark", SF2)["text"], strict=True)]
    items = [(k, t) for k, t in items if len(t) >= 130][:12]
    texts, lead = [], " ".join("".join(r.choice("xyzw") for _ in range(5)) for _ in range(8))
    for _, t in items:
        for budget in (0, 4, 6, 8, 16):
            at = r.randrange(len(t) - 120)
            part = list(t[at : at + 120])
            for _ in range(budget):
                k = r.randrange(len(part))
                part[k : k + 1] = r.choice((["#"], [part[k], "#"], []))
            texts.append(normal(f"{lead} {''.join(part)} {lead}"))
    block = decontam.Block(items, decontam.WINDOW, decontam.MIN_CHARS, decontam.EDITS)
    windows = [(int(block.owner[o]), "".join(map(chr, block.part(o))), int(block.budget[o])) for o in range(len(block.owner))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in enumerate(texts):
        own = items[d // 5][0]
        best = min(edits_within(w, text) / b if b else 9 for o, w, b in windows if o == own)
        if best <= 1:
            want[d, own] = min(edits_within(w, text) for o, w, b in windows if o == own if edits_within(w, text) <= b)
    assert {k for k, v in got.items() if v == 0} >= {k for k, v in want.items() if v == 0}
    assert got.keys() <= want.keys() | {(d, i) for d, i in got if i != items[d // 5][0]} and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert 20 < len(want) < len(texts)


def test_blocks_are_bounded_and_equal_one_block(spark, monkeypatch):
    import pickle

    documents, items = table(spark, SF2, "documents"), table(spark, SF2, "benchmark")
    whole = sorted(map(repr, decontam.matches(documents, items).collect()))
    clean = sorted(x["doc_id"] for x in decontam.decontaminate(documents, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 9000)
    assert sorted(map(repr, decontam.matches(documents, items).collect())) == whole
    assert sorted(x["doc_id"] for x in decontam.decontaminate(documents, items).collect()) == clean
    text = "".join(chr(97 + k * k % 23) + chr(97 + k * 7 % 26) + " " * (k % 5 == 0) for k in range(50_000))
    block = decontam.Block([(k, text[k * 250 : k * 250 + 250] + str(k)) for k in range(400)], 80, 40, 0.08)
    assert len(pickle.dumps(block)) / block.points.size * 2_000_000 < 100e6


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    want = con.sql(registry.OP4_SQL).df().sort_values(["doc_id"]).reset_index(drop=True)
    got = registry.op4_line_dedup(spark, SF2).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    assert got["text"].tolist() == want["text"].tolist()
    assert got["n_lines"].tolist() == want["n_lines"].tolist() and got["n_removed"].tolist() == want["n_removed"].tolist()
    assert got["n_removed"].sum() > 0


def test_extraction(spark):
    pages = rows("pages")
    found = registry.op5_html_extraction(spark, SF).toPandas().set_index("page_id")
    assert len(found) == len(pages)
    for p, page in zip(pages["page_id"], pages["html"], strict=True):
        body = re.search("<article>(.*)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub("<(?:/?(?:p|h1)|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert found.loc[p, "text"] == want and found.loc[p, "n_chars"] == len(want)


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_pairs_by_hand(spark):
    """Neighbours of each page in the order of host and path, over the whole table at once, and the plain table of alignment."""
    from urllib.parse import urlsplit

    pages = rows("pages", SF2)
    got = registry.op5_html_extraction(spark, SF2).toPandas().set_index("page_id")
    tie = {r["page_id"]: r["h"] for r in table(spark, SF2, "pages").select("page_id", F.hex(F.xxhash64("page_id")).alias("h")).collect()}
    order = []
    for p, url, page in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
        parts = urlsplit(url)
        host = parts.netloc.removeprefix("www.")
        order.append((host, parts.path + (f"?{parts.query}" if parts.query else ""), tie[p].rjust(16, "0"), p, [t for t, *_ in extract.page_blocks(page)]))
    order.sort()
    by_id = {row[3]: row for row in order}
    own_pairs = 0
    for k, row in enumerate(order):
        near = [n for n in (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) if n is not None and n[0] == row[0] and n[4] != row[4]]
        pair = got.loc[row[3], "pair_id"]
        if near and not np.isnan(pair):
            assert by_id[int(pair)][0] == row[0]
            assert got.loc[row[3], "n_shared"] == longest_common(row[4], by_id[int(pair)][4])
            own_pairs += int(pair) in {n[3] for n in near}
    assert own_pairs > 0.9 * sum(got["pair_id"].notna()) > 100


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(shingles))


def reachable(prints, radius):
    own, parent = list(prints), {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in own}


def test_simhash(spark, docs):
    want = {d: simhash_brute(t) for d, t in docs.items()}
    got = registry.op6_simhash(spark, SF).toPandas()
    assert dict(zip(got["doc_id"], got["fingerprint"], strict=True)) == {d: f"{f:016x}" for d, f in want.items()}
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == reachable(want, 2)


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(registry.OP7_SQL)
    got = registry.op7_chat_formatting(spark, SF)
    assert set(got.columns) == set(want.columns)
    found = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert found and found == sorted(map(repr, want.fetchall()))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer())
    got = registry.op8_packing(spark, SF).toPandas().sort_values(["doc_id", "piece"])
    own = defaultdict(list)
    for r in got.itertuples():
        own[r.doc_id].append(r)
    total = 0
    for d, t in docs.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert [r.piece for r in own[d]] == list(range(-(-len(ids) // 4096)))
        for r in own[d]:
            part = ids[r.start : r.start + 4096]
            assert r.start == r.piece * 4096 and r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    bins = defaultdict(list)
    for r in got.itertuples():
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def spots_of(text):
    """Signatures by their definition, word by word."""
    words = re.findall(r"\w+", text.lower())
    found = set()
    for k, w in enumerate(words):
        chain = [x for x in words[k + 1 :] if x not in spotsigs.ANCHORS][:2]
        if w in spotsigs.ANCHORS and len(chain) == 2:
            found.add(" ".join([w, *chain]))
    if not found:
        found = {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} or {" ".join(words) or text}
    return {xxhash.xxh32_intdigest(s.encode()) for s in found}


def linked_groups(group_of):
    """Groups as sets of ids, whatever they are called."""
    found = defaultdict(set)
    for d, g in group_of.items():
        found[g].add(d)
    return {frozenset(v) for v in found.values()}


def near_by_hand(sets, threshold):
    """Groups of ids joined by likeness at the threshold, over all pairs."""
    own, parent = sorted(sets), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(own):
        for b in own[:k]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                parent[root(a)] = root(b)
    return linked_groups({d: root(d) for d in own})


def test_spotsigs(spark, docs):
    got = registry.op9_spotsigs(spark, SF).toPandas().set_index("doc_id")
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    sets = {d: frozenset(spots_of(t)) for d, t in docs.items()}
    for d, n in zip(order, [*order[1:], order[0]], strict=True):
        text, half = docs[d], len(docs[d]) // 2
        new = text[: len(text) - half] + docs[n][:half]
        r = got.loc[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = sets[d], spots_of(new), sets[n]
        assert set(spotsigs.decoded(r["fingerprint"]).tolist()) == a and set(spotsigs.decoded(r["edited_fingerprint"]).tolist()) == b
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.2
    assert linked_groups({d: int(g) for d, g in got["near_id"].items()}) == near_by_hand(sets, 0.8)
    by_class = {}
    for d in docs:
        by_class.setdefault(int(got.loc[d, "class_id"]), set()).add(sets[d])
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == len(set(sets.values()))


def test_language_held_out(spark):
    got = registry.op10_language(spark, SF2).toPandas().merge(rows("documents", SF2)[["doc_id", "lang"]], on="doc_id")
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]])
    assert (got["held_out"].to_numpy() == held).all() and got["score"].between(0, 1).all()
    own = got[got["held_out"] & got["lang"].notna()]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.97
    assert 0 < got["rejected"].mean() < 0.3


def test_language_scores_by_hand(spark):
    """Counts, TF-IDF, cosine and rejection of each text, n-gram by n-gram."""
    from collections import Counter
    from math import log, sqrt

    documents = table(spark, SF, "documents")
    model = langid.fit(documents, ~held_out(F.col("doc_id"), 4, 2))
    got = {r["doc_id"]: r for r in registry.op10_language(spark, SF).collect()}
    mask = (1 << 64) - 1
    for d, text in list(zip(rows("documents")["doc_id"], rows("documents")["text"], strict=True))[:60]:
        if not text or not any(map(str.isalpha, text)):
            assert got[d]["lang_pred"] == "und"
            continue
        points = [32, *(p if 97 <= p <= 122 or p >= 0xC0 and p not in (0xD7, 0xF7) and not 0x2000 <= p <= 0x206F else 32 for p in map(ord, text.lower())), 32]
        count = Counter()
        for a, b, c in zip(points, points[1:], points[2:], strict=False):
            if b != 32:
                count[(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F & mask) >> 52] += 1
                count[(a * 0x9E3779B97F4A7C15 + b * 0x165667B19E3779F9 + c * 0x27D4EB2F165667C5 & mask) >> 52] += 1
        weight = {k: log(1 + n) * float(model.idf[k]) for k, n in count.items()}
        norm = sqrt(sum(w * w for w in weight.values()))
        close = [sum(w * float(v[k]) for k, w in weight.items()) / norm for v in model.vectors]
        best = max(range(len(close)), key=lambda k: close[k])
        assert got[d]["score"] == pytest.approx(close[best], abs=1e-4)
        assert got[d]["lang_pred"] == model.langs[model.lang_of[best]]
        assert got[d]["rejected"] == (1 - close[best] > model.farthest[best] + langid.SLACK) or abs(1 - close[best] - model.farthest[best] - langid.SLACK) < 1e-4


def test_quality_scores_by_hand(spark):
    """Some statistics by definition, and each tree walked node by node."""
    from math import exp

    trees = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    got = {r["doc_id"]: r for r in registry.op1_quality(spark, SF).collect()}
    place = {f: k for k, f in enumerate(quality.FEATURES)}
    for d, text in zip(rows("documents")["doc_id"], rows("documents")["text"], strict=True):
        x = quality.statistics(text)
        raw, words = text.encode(), text.encode().split()
        lines = [y for y in raw.split(b"\n") if y.strip()]
        if words:
            sizes = [len(w) for w in words]
            own = {
                "bytes": np.log(1 + len(raw)), "words": np.log(1 + len(words)), "mean_word": sum(sizes) / len(sizes), "longest_word": max(sizes),
                "distinct_words": len(set(words)) / len(words), "top_word": max(words.count(w) for w in set(words)) / len(words),
                "digits": sum(48 <= c < 58 for c in raw) / len(raw), "lines": np.log(1 + len(lines)), "longest_line": max(map(len, lines)),
                "distinct_lines": len(set(lines)) / len(lines), "short_words": sum(n <= 2 for n in sizes) / len(sizes),
            }
            assert all(x[place[f]] == pytest.approx(v) for f, v in own.items())
        total = trees.base
        for t in range(trees.feature.shape[0]):
            node = 0
            for _ in range(trees.depth):
                node = trees.left[t, node] if x[trees.feature[t, node]] <= trees.threshold[t, node] else trees.right[t, node]
            total += trees.value[t, node]
        assert got[d]["score"] == pytest.approx(1 / (1 + exp(-total)), abs=1e-9)


def test_results_do_not_depend_on_partitions(spark):
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pages = registry.op5_html_extraction(spark, SF2).collect()
            packed = registry.op8_packing(spark, SF2).collect()
            found.append((sorted(map(repr, pages)), sorted(map(repr, packed))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] and found[0][0]
