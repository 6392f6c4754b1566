"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from varloom.llm import chat, decontam, extract, langid, linededup, packing, quality, registry, simhash, spotsigs, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, gone string, id string, mine string, n long"
LONG = "the cat sat on a mat and saw the dog. " * 4000
TEXT = "The quick brown fox jumps over the lazy dog while the old man and a young girl watch from the bridge. " * 3


def row(doc, text, lang="en", source="s"):
    return (doc, text, lang, source, None, "x", "y", "z", "w", 7)


ROWS = [
    row(1, TEXT), row(1, TEXT), row(2, TEXT, source=None), row(3, None), row(4, ""), row(5, "   \n\t "), row(6, LONG), row(None, TEXT), row(None, None),
    row(7, "…!?"), row(8, "one"), row(9, TEXT + " tail", lang=None), row(10, "Ünïcödé 漢字 \x00 text"), row(11, "der die das und der Hund", "de"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0, 9), (1, 1, 0, 9), (3, 0, 0, 9), (4, 0, 0, 9), (6, None, 0, 9), (None, 1, 0, 9), (8, 5, 0, 9)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text int")


def test_quality(spark, docs, labels):
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
    none = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, none).collect()} <= {0.5}


def test_quality_trees_learn_xor():
    import numpy as np

    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    alone = np.array([trees.score(r[None, :])[0] for r in x[:50]])
    assert np.allclose(alone, trees.score(x[:50]))


def test_token_counts(spark, docs):
    lengths = tokencount.token_lengths(docs, registry.tokenizer())
    sums = tokencount.suffix_sums(tokencount.histogram(lengths))
    own = [r["n_tokens"] for r in lengths.collect()]
    assert len(own) == docs.count()
    for limit in (1, 5, 100, 10**6):
        assert tokencount.truncated_total(sums, limit).first()[0] == sum(min(n, limit) for n in own)
    middle = tokencount.quantile(sums, 0.5).first()[0]
    assert middle == (sorted(own)[(len(own) - 1) // 2] if own else None)


def test_decontamination(spark, docs):
    items = [(1, TEXT[:150], "a"), (2, None, "a"), (3, "", "a"), (4, "short", "a"), (5, TEXT[:150], "a"), (None, LONG[:300], "a")]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = decontam.matches(docs, bench).collect()
    clean = decontam.decontaminate(docs, bench).collect()
    dirty = [r for r in ROWS if r[1] and TEXT in r[1]] if docs.count() else []
    assert {r["doc_id"] for r in found} == {r[0] for r in dirty} and {r["item_id"] for r in found} <= {1}
    assert len(clean) == docs.count() - len(dirty) and all(not r["text"] or TEXT not in r["text"] for r in clean)
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()
    assert decontam.matches(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize(("inline", "open_"), [(0, 200_000), (4000, 0), (4000, 200_000)])
def test_line_dedup(spark, monkeypatch, inline, open_):
    """Against distinct counts in Python: short lines, copies, nulls, a long text, the n_lines of an input."""
    monkeypatch.setattr(linededup, "OPEN", open_)
    line, own, copied = "All rights are reserved here.", "Some words of text that stand only here, number {} of all.", "A page that was copied\nto every site."
    rows = [row(k, f"{own.format(k)}\n{line}\nLes.\n\n{own.format(k)} again", source=f"s{k}") for k in range(8)]
    rows += [row(20 + k, copied, source=f"s{k}") for k in range(8)]
    rows += [row(8, line, source="s1"), row(9, None), row(None, f" {line} \n{own.format('x')}", source=None), row(10, ""), row(11, f"{line}\n" * 40_000 + "end", source="s2")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = linededup.dedup_lines(docs, sites=4, inline=inline)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    sites, texts = {}, {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).update({r[3]} - {None})
                texts.setdefault(x.strip(" "), set()).add(r[1])
    bad = {x for x in sites if len(sites[x]) >= 4 and len(texts[x]) >= 4}
    assert bad == {line, "Les."}
    want = sorted((r[0] or -1, None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in bad), r[5]) for r in rows if r[1] is not None)
    got = found.collect()
    assert sorted((r["doc_id"] or -1, r["text"], r["score"]) for r in got if r["text"] is not None) == want and len(got) == len(rows)
    assert next(r["n_removed"] for r in got if r["doc_id"] == 11) == 40_000
    assert linededup.dedup_lines(docs.where("false"), inline=inline).count() == 0
    assert linededup.dedup_lines(docs, sites=10, inline=inline).agg(F.sum("n_removed")).first()[0] == 0
    kept = linededup.dedup_lines(docs.withColumns({"n_lines": F.lit("mine"), "kept": F.lit(3), "gone": F.lit(4)}), sites=4, inline=inline)
    assert {(r["n_lines"], r["kept"], r["gone"]) for r in kept.collect()} == {("mine", 3, 4)}


MENU = "<html><body><div>Menu of all pages here</div>{}<div>Footer text of the site</div></body></html>"


def texts_of(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, bucket int")
    got = extract.main_text(frame).collect()
    assert len(got) == len(rows)
    text = {}
    for r in got:
        text.setdefault(r["page_id"], []).append(r["text"])
    return text


def test_extraction(spark):
    rows = [(k, f"http://h.com/a/{k}", MENU.format(f"<div>Own text of page {k}.</div>"), "t", 5) for k in range(6)]  # short texts in a larger template
    rows += [(k, f"http://h.com/a/5?print={k}", MENU.format("<div>Own text of page 5.</div>"), "t", 5) for k in (6, 7)]  # copies beside it
    rows += [(10, None, None, "t", 5), (11, "http://x/", "", "t", 5), (11, "http://x/", "<p>a &amp; b<script>no</script>", "t", 5), (12, "http://[bad", "<article>x<br>y</article>", "t", 5), (None, "", "<p", "t", 5)]
    rows += [(13, None, MENU.format("<p>no url</p>"), "t", 5)] * 2
    text = texts_of(spark, rows)
    for k in range(8):
        assert text[k] == [f"Own text of page {min(k, 5)}."]
    assert text[10] == [""] and sorted(text[11]) == ["", "a & b"] and text[12] == ["x y"]
    assert text[13] == ["Menu of all pages here no url Footer text of the site"] * 2
    assert extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_pair_decides_within_a_marked_article(spark):
    page = "<html><body><article><h1>Title {0}</h1><div>Share this story</div><p>Text of {0}.</p><p>A quoted sentence.</p><div>Caption {0}</div></article></body></html>"
    text = texts_of(spark, [(k, f"http://h.com/a/{k}", page.format(k), "t", 5) for k in range(4)])
    assert all(text[k] == [f"Title {k} Text of {k}. A quoted sentence. Caption {k}"] for k in range(4))
    alone = texts_of(spark, [(0, "http://h.com/a/0", page.format(0), "t", 5)])
    assert alone[0] == ["Title 0 Share this story Text of 0. A quoted sentence. Caption 0"]


def test_a_near_copy_is_not_taken_for_a_template(spark):
    story = "".join(f"<div>Sentence {k} of the story that two pages tell.</div>" for k in range(30))
    rows = [(0, "http://h.com/a/0", MENU.format(f"{story}<div>Edition one</div>"), "t", 5), (1, "http://h.com/a/1", MENU.format(f"{story}<div>Edition two</div>"), "t", 5)]
    rows += [(k, f"http://h.com/a/{k}", MENU.format(f"<div>Another text {k}</div>"), "t", 5) for k in (2, 3)]
    text = texts_of(spark, rows)
    assert text[1][0].startswith("Sentence 0") and text[1][0].endswith("Edition two") and "Menu" not in text[1][0]


@pytest.mark.parametrize("html", ["<a " * 350_000, "</x>" * 250_000, "<b><div>" + "<span>" * 100_000 + "</b>" * 100_000, "<!" * 500_000, "<span>" * 100_000 + "<hr>" * 100_000, "<a href='" * 100_000])
def test_tags_cost_what_they_are_long(html):
    import time

    began = time.perf_counter()
    extract.page_blocks(html)
    assert time.perf_counter() - began < 10


def test_alignment_equals_the_plain_table(monkeypatch):
    import random

    from tests.llm.test_contracts import longest_common

    r = random.Random(3)
    monkeypatch.setattr(extract, "SMALL", 6)
    for bits in (8, 8192):
        monkeypatch.setattr(extract, "BITS", bits)
        for _ in range(200):
            kinds = r.choice((2, 5, 30))
            a, b = ([r.randrange(kinds) for _ in range(r.randrange(50))] for _ in "ab")
            keep, rest = extract.shared_lines(a, b), iter(b)
            assert len(keep) == longest_common(a, b) and all(any(v == a[k] for v in rest) for k in keep)


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = {r["component_id"] for r in got if r["f0"] == 0}
    assert zero <= {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} <= {1}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids.count(1) == (1 if docs.count() else 0) and 2 not in ids and 4 not in ids


def test_simhash_tiles_and_chains(spark):
    """Small tiles, and a chain in which only neighbours are within the radius."""
    import random

    r = random.Random(5)
    prints, x = {}, r.getrandbits(64)
    for k in range(40):
        prints[k] = x
        x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    for k in range(40, 400):
        prints[k] = r.getrandbits(64)
    for k in range(400, 460):
        prints[k] = prints[100] ^ (1 << k % 64)
    rows = [(k, v - (1 << 64) if v >> 63 else v, 9) for k, v in prints.items()]
    frame = spark.createDataFrame(rows, "doc_id long, f0 long, n int")
    from tests.llm.test_contracts import reachable

    want = reachable(prints, 2)
    for tile in (3, None):
        got = simhash.groups(frame, 1, 2, tile=tile).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_copies_go(spark):
    import random

    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [[r.choice(words) for _ in range(300)] for _ in range(30)]
    rows = [row(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(10):
        t = list(texts[k])
        t[100] = "changed"
        rows.append(row(100 + k, " ".join(t)))
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(30))


def test_packing(spark, docs):
    got = packing.pack_documents(docs, registry.tokenizer()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["start"] == 0 for r in got) == docs.count()
    many = [(k, 0, 0, 1 + k * 37 % 90, k) for k in range(3000)]
    cut = spark.createDataFrame(many, packing.PIECES)
    packed = packing.pack(cut, 100, group_rows=400).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(packed) == 3000
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 100
    whole = packing.best_fit(packing.np.array([m[3] for m in many]), 100)[2]
    assert len(bins) <= len(whole) * 1.02 + 1


def test_packing_splits_equal_rows(spark):
    """A third of all rows equal each other: no group gets more than its share of them, and all are packed."""
    rows = [(None, 0, 0, 7, 5)] * 1000 + [(k, 0, 0, 1 + k * 37 % 90, k) for k in range(2000)]
    cut = spark.createDataFrame(rows, packing.PIECES)
    shares = [r["n"] for r in packing._deal(cut, 10, 0).groupBy("dealt").agg(F.sum("copies").alias("n")).collect()]
    assert sum(shares) == 3000 and max(shares) < 400
    packed = packing.pack(cut, 100, group_rows=300).collect()
    assert len(packed) == 3000 and sum(r["doc_id"] is None for r in packed) == 1000
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == 3000


def test_spotsigs(spark, docs):
    got = spotsigs.with_next(docs).collect()
    assert len(got) == docs.count()
    if got:
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        same = {r["fingerprint"] for r in got if r["n_chars"] == len(TEXT)}
        assert len(same) == 1
    near = spotsigs.near_duplicates(docs, 0.8).collect()
    assert len(near) == docs.count()


def test_spotsigs_ranges(spark, monkeypatch):
    """Small ranges, many rows without id and many of one id give what one range gives."""
    rows = [(None, f"the text number {k} of those without id") for k in range(60)] + [(5, f"the same id and text {k % 40}") for k in range(80)] + [(k, f"the plain text of {k}") for k in range(20, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(repr, spotsigs.with_next(frame).collect()))
    monkeypatch.setattr(spotsigs, "RANGE", 7)
    assert sorted(map(repr, spotsigs.with_next(frame).collect())) == whole and len(whole) == 160


def test_spotsigs_groups_equal_brute_force(spark, monkeypatch):
    import random

    r = random.Random(3)
    base = [" ".join(r.choice(["the", "of", "and", "river", "stone", "house", "light", "green"]) + str(r.randrange(3)) * r.randrange(2) for _ in range(80)) for _ in range(15)]
    texts = base + [t.replace("river", "lake", 1) for t in base] + base[:3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tests.llm.test_contracts import linked_groups, near_by_hand

    sets = {k: frozenset(spotsigs.signatures(t).tolist()) for k, t in enumerate(texts)}
    for threshold, window in ((0.5, 1 << 15), (0.8, 1 << 15), (0.8, 3)):
        monkeypatch.setattr(spotsigs, "WINDOW", window)
        got = {x["doc_id"]: x["near_id"] for x in spotsigs.near_duplicates(frame, threshold).collect()}
        want = near_by_hand(sets, threshold)
        assert linked_groups(got) == want and len(want) < len(base) * 2


def test_language(spark, docs):
    model = langid.fit(docs)
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for r in got.values():
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"])))
    none = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} <= {"und"}
    assert all(r["rejected"] for r in got.values() if r["lang_pred"] == "und")


def test_language_rejects_what_is_far(spark):
    rows = [(k, f"the old man and the sea number {k} went to the river", "en") for k in range(40)] + [(100 + k, f"der alte mann und das meer ging {k} zum fluss", "de") for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), reject=True)
    asked = spark.createDataFrame([(1, "the man went to the sea"), (2, "ξψζθ ωρστ υφχ"), (3, "das meer und der fluss"), (4, "qqzx jjkv xwqz")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.predict(asked, model).collect()}
    assert got[2] == got[4] == ("und", True)
    model.reject = False
    loose = {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()}
    assert loose[1] == "en" and loose[3] == "de" and "und" not in loose.values()


def test_every_language_is_learned(spark):
    import random

    r = random.Random(1)
    rows = []
    for k in range(250):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüéèñ") for _ in range(4)) for _ in range(30)]
        rows += [(10 * k + j, " ".join(r.choice(words) for _ in range(60)), f"l{k}") for j in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert len(model.langs) == 250
    got = langid.predict(frame, model).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) > 0.98 * len(got)


SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": ["integer", "object"]}}, "additionalProperties": False}}


def test_chat(spark):
    def call(i, args, name="add"):
        return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}]})

    def result(i):
        return json.dumps({"tool_call_id": i, "content": "5"})

    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("x")), (1, 2, "assistant", call("x", {"a": 1, "b": 2})), (1, 3, "assistant", call("y", {"a": "no"})),
        (1, 4, "assistant", call("x", {"b": 1, "a": 9})), (1, 5, "tool", result("none")), (1, 6, "assistant", call("z", {"a": 1, "b": {"$ref": "x"}})),
        (1, 7, "tool", result("z")), (2, 0, None, None), (None, 0, "assistant", call("x", {})), (2, 1, "assistant", "{broken"), (2, None, "tool", result("q")),
        (3, 0, "assistant", call("c", {"a": 1, "b": {"$ref": "d"}})), (3, 1, "assistant", call("d", {"a": 1, "b": {"$ref": "c"}})), (3, 2, "tool", result("c")),
        (3, 3, "tool", result("d")), (2, 0, None, None),
    ]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = chat.format_chats(frame, SCHEMAS).collect()
    assert len(got) == len(rows)
    status = {(r["conv_id"], r["turn"]): r["status"] for r in got}
    assert [status[1, k] for k in range(8)] == ["plain", "linked", "linked", "invalid", "duplicate", "orphan", "linked", "linked"]
    assert status[2, 0] == status[2, 1] == "plain" and status[2, None] == "orphan" and status[None, 0] == "invalid" and status[3, 0] == "cycle"
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["at_turn"], r["depth"], r["turn"], r["part"]))]
    assert order.index(2) < order.index(1) and order.index(1) < order.index(6) < order.index(7)
    body = next(r["body"] for r in got if (r["conv_id"], r["turn"]) == (1, 2))
    assert body == '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":2},"id":"x","name":"add"}}'
    assert chat.format_chats(frame.where("false"), SCHEMAS).count() == 0


def call_text(i, args, name="add"):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}]})


def result_text(i):
    return json.dumps({"tool_call_id": i, "content": "5"})


@pytest.mark.parametrize("group", [1, 200_000])
def test_long_chains_are_linked(spark, group):
    many = 8 if group == 1 else 200
    rows = []
    for k in range(many):
        rows += [(1, many - k, "assistant", call_text(f"c{k}", {"a": 1, "b": {"$ref": f"c{k - 1}"} if k else 2})), (1, 300 + k, "tool", result_text(f"c{k}"))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS, group=group).collect()
    assert {r["status"] for r in got} == {"linked"}
    place = {(r["kind"], r["call_id"]): (r["at_turn"], r["depth"], r["turn"], r["part"]) for r in got}
    for k in range(many):
        assert place["call", f"c{k}"] < place["result", f"c{k}"]
        assert k == 0 or place["result", f"c{k - 1}"] < place["call", f"c{k}"]


def plain_status(rows, schemas):
    """Status of every part and the calls that can be placed, by repeated passes over a list."""
    parts = [(c, t, p, *x) for c, t, role, text in rows for p, x in enumerate(chat.read_turn(role, text, schemas))]
    first = {}
    for q in sorted((q for q in parts if q[4] == "call" and q[5] is not None and q[0] is not None), key=lambda q: (q[1] is not None, q[1], q[2], q[9])):
        first.setdefault((q[0], q[5]), q)
    answered = {(q[0], q[5]) for q in parts if q[4] == "result"}
    placed, moved = set(), True
    while moved:
        moved = False
        for key, q in first.items():
            if key not in placed and all((q[0], r) in placed or (q[0], r) not in first for r in q[8]):
                placed.add(key)
                moved = True
    out = []
    for q in parts:
        key = (q[0], q[5])
        known = q[0] is not None and key in first
        if q[4] == "message":
            s = "plain"
        elif q[4] == "result":
            s = "orphan" if not known else "cycle" if key not in placed else "linked"
        elif known and first[key][:3] + (first[key][9],) != q[:3] + (q[9],):
            s = "duplicate"
        elif known and key not in placed:
            s = "cycle"
        else:
            s = "invalid" if q[7] else "linked" if known and key in answered else "unanswered"
        out.append((q[0], q[1], q[2], q[4], q[5], s))
    return out


@pytest.mark.parametrize("group", [1, 200_000])
def test_random_conversations_equal_plain_code(spark, group):
    import random

    r, rows = random.Random(11), []
    for conv in (*range(6 if group == 1 else 40), None):
        for turn in range(r.randrange(3, 14)):
            kind = r.random()
            ident = f"c{r.randrange(6)}"
            if kind < 0.5:
                arg = r.choice([1, "x", {"$ref": f"c{r.randrange(8)}"}, {"$ref": f"c{r.randrange(8)}"}, [1], None])
                rows.append((conv, turn, "assistant", call_text(r.choice([ident, None, 5]), {"a": r.choice([1, 2.0, True]), "b": arg}, r.choice(["add", "add", "none", ["add"]]))))
            else:
                rows.append((conv, turn, r.choice(["tool", "user", None]), result_text(ident) if kind < 0.85 else r.choice(["hi", "", None, "{"])))
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS, group=group).collect()
    key = lambda x: repr(x)
    found = sorted(((x["conv_id"], x["turn"], x["part"], x["kind"], x["call_id"], x["status"]) for x in got), key=key)
    assert found == sorted(plain_status(rows, SCHEMAS), key=key)
    assert {"linked", "cycle", "duplicate", "invalid", "orphan", "unanswered", "plain"} == {x[-1] for x in found} or group == 1
    place = {}
    for x in got:
        if x["kind"] == "call" and x["status"] in ("linked", "invalid", "unanswered") and x["conv_id"] is not None and x["call_id"]:
            place[x["conv_id"], x["call_id"]] = (x["at_turn"], x["depth"])
    for x in got:
        for ref in chat.references(json.loads(x["body"])) if x["status"] == "linked" and x["kind"] == "call" else ():
            assert (x["conv_id"], ref) not in place or place[x["conv_id"], ref] < (x["at_turn"], x["depth"])


def test_odd_json(spark):
    deep = "[" * 3000 + "]" * 3000
    texts = [
        '{"tool_calls": [{"id": "\\ud800", "name": "add", "arguments": {}}]}', '{"tool_calls": [{"id": "d", "name": "add", "arguments": ' + deep + "}]}",
        '{"tool_calls": [{"id": "e", "name": "add", "arguments": {"a": ' + "9" * 400 + ', "b": 1}}]}', '{"tool_calls": [{"id": "f", "name": ["add"], "arguments": {}}]}',
        '{"tool_calls": [{"id": "g", "name": "add", "arguments": {"a": NaN, "b": 1}}]}', '{"tool_calls": [{"id": "h", "name": "add", "arguments": {"a": 1e999, "b": 1}}]}',
        '{"tool_calls": [{"id": "i", "name": "add", "arguments": {"a": ' + "9" * 5000 + "}}]}", "{" + LONG, '{"tool_calls": []}',
    ]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)]
    got = {r["turn"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert [got[k]["status"] for k in range(9)] == ["invalid", "plain", "unanswered", "invalid", "plain", "plain", "plain", "plain", "plain"]
    assert got[0]["call_id"] == "\ufffd" and got[3]["error"] == "unknown tool"
    for r in got.values():
        json.loads(r["body"], parse_constant=lambda c: pytest.fail(c))


@pytest.mark.parametrize("rows_of_tile", [4, 1 << 11])
def test_near_copies_are_those_of_exact_jaccard(spark, monkeypatch, rows_of_tile):
    """Texts with about a fifth of their shingles changed, at either side of 0.8, against brute force over whole sets."""
    import random

    monkeypatch.setattr(simhash, "SET_ROWS", rows_of_tile)
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = []
    for k in range(40):
        base = [r.choice(words) for _ in range(r.choice((30, 60, 200)))]
        texts.append(" ".join(base))
        for _ in range(4):
            t = list(base)
            for at in r.sample(range(len(t)), max(1, round(len(t) * r.choice((0.015, 0.02, 0.025, 0.03))))):
                t[at] = r.choice(words)
            texts.append(" ".join(t))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    want = {root(k) for k in range(len(texts))}
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA)).collect()}
    assert kept == want and 40 < len(want) < len(texts)


def test_parities_never_rule_out_a_similar_set():
    """At every width that two sets share, and folded from the wider ones as counted anew."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for size in (3, 100, 128, 140, 500, 520, 900, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**32, size, dtype=np.uint32))
            moved = int(len(a) / 9)
            b = np.unique(np.concatenate([a[moved:], rng.integers(0, 2**32, moved, dtype=np.uint32)]))
            shared = len(np.intersect1d(a, b))
            assert shared / (len(a) + len(b) - shared) >= 0.79
            apart = len(a) + len(b) - 2 * shared
            column = pa.array([b"12345678", spotsigs.parity(a), spotsigs.parity(b)], pa.binary())[1:]
            for places, words in zip((64, 256, 512), spotsigs.folded(column), strict=True):
                words = words.reshape(2, -1)
                if not words.any(1).all():
                    continue
                assert int(np.bitwise_count(words[0] ^ words[1]).sum()) <= apart
                for x, got in zip((a, b), words, strict=True):
                    at = ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)) & np.uint32(places - 1)
                    assert (got == np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").view(np.uint64)).all()


def test_words_in_bytes_are_those_of_the_expression():
    """Every character, between letters and at the ends, and the ones that change length or meaning in lower case."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}B {c}Z{c}" for c in every[:0x3000]] + ["x".join(every[k : k + 40]) for k in range(0, len(every), 40)]
    texts += ["", "ÀÉ ΑΣ Σ ΣΑΣ.ΣΑ", "İstanbul K Å", "don’t « vous » ! l’été", "\x00a\x1cb\x85c d_e", "a\ud800b"]
    for t in texts:
        want = [w.encode() for w in spotsigs.WORD.findall(t.lower())]
        assert spotsigs.words_of(t) == want, ascii(t)


def test_short_lists_are_compared_together(monkeypatch):
    """Thousands of short posting lists in a batch are no step each, and link what they link one at a time."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**32, int(rng.integers(4, 700)), dtype=np.uint32)) for _ in range(400)]
    for k in range(600):  # near copies, some of them over the threshold
        a = sets[k % 400]
        sets.append(np.unique(np.concatenate([a[a.size * int(rng.integers(0, 4)) // 12 :], rng.integers(0, 2**32, 1, dtype=np.uint32)])))
    rows = sorted((s, sets[k].size, k) for s in range(3000) for k in {s % 400, 400 + s % 400, 400 + s % 600, *rng.integers(0, 1000, s % 9).tolist()})
    spot, n, ids = (np.array(c) for c in zip(*rows, strict=True))
    columns = [pa.array(spot), pa.array(n.astype(np.int32)), pa.array([spotsigs.parity(sets[k]) for k in ids.tolist()], pa.binary()), pa.array(ids)]
    whole = pa.RecordBatch.from_arrays(columns, ["spot", "n", "odd", "class_id"])
    want = simhash.Trees(len(sets))
    for s in range(3000):
        own = ids[spot == s].tolist()
        for x in own:
            for y in own:
                a, b = sets[x], sets[y]
                if x < y and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    want.add(np.array([x]), np.array([y]))
    assert len(want.left) > 100

    def forest(batches):
        found, trees = list(spotsigs._compared(0.8)(iter(batches))), simhash.Trees(len(sets))
        for b in found:
            trees.add(b.column(0).to_numpy(), b.column(1).to_numpy())
        return len(found), trees.label

    steps, got = forest([whole])
    assert steps < 5
    assert (got[want.left] == got[want.right]).all()
    cut = [whole.slice(k, 997) for k in range(0, whole.num_rows, 997)]
    assert (forest(cut)[1] == got).all()
    monkeypatch.setattr(spotsigs, "SHORT", 0)
    assert (forest([whole])[1] == got).all()
