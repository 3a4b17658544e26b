"""Decontamination, embeddings, mixing, HTML and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from lurewatch.llm import decontaminate, embedding_dedup, html_extract, mixing
from lurewatch.llm import text as T
from lurewatch.llm.queries import QUERIES


def encoded(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def nearest_runs(texts, items):
    """(row, item) -> least word edit distance of any run of words, by the whole table of distances with both ends free."""
    out = {}
    for i, item in items:
        want = decontaminate.words(*encoded([item]))[0].tolist()
        for r, t in enumerate(texts):
            have = decontaminate.words(*encoded([t]))[0].tolist()
            row = [0] * (len(have) + 1)
            for x, word in enumerate(want, 1):
                new = [x]
                for y, other in enumerate(have):
                    new.append(min(row[y] + (word != other), row[y + 1] + 1, new[y] + 1))
                row = new
            if min(row) <= int(0.2 * len(want) + 1e-9):
                out[r, i] = min(row)
    return out


@pytest.mark.parametrize("place", ["anywhere", "first half"])
def test_recall_of_walks_against_all_runs(place):
    """Items of 2 to 60 words with as many edits as are allowed, of one kind or mixed, spread or in one half."""
    rng = np.random.default_rng(4)
    vocabulary = np.array(["".join(rng.choice(list("abcdefg"), rng.integers(2, 6))) for _ in range(400)])
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(2, 60)))) for i in range(40)]
    texts = []
    for k in range(160):
        words, kinds = items[k % 40][1].split(), [(0,), (1,), (2,), (0, 1, 2)][k // 40]
        for _ in range(int(0.2 * len(words) + 1e-9)):
            at, new = int(rng.integers(len(words) if place == "anywhere" else (len(words) + 1) // 2)), str(rng.choice(vocabulary))
            kind = rng.choice(kinds)
            words[at : at + (kind != 1)] = [] if kind == 0 else [new]
        texts.append(" ".join([*rng.choice(vocabulary, rng.integers(0, 60)), *words, *rng.choice(vocabulary, rng.integers(0, 60))]))
    want = nearest_runs(texts, items)
    got = {(r, i): d for r, i, d, _, _ in decontaminate.search(decontaminate.build_index(items, least_words=1), *encoded(texts))}
    assert set(got) <= set(want) and len(want) >= 150 and len(got) >= 0.97 * len(want)
    assert all(got[k] == 0 for k in want if want[k] == 0)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)


def test_walks_decide():
    """A pair without a common key is not compared: without walks only items of one word are found."""
    index = decontaminate.build_index([(1, "one two three four five six"), (2, "seven")], walks=0, least_words=1)
    texts = encoded(["one two three four five six seven"])
    assert [r[1] for r in decontaminate.search(index, *texts)] == [2] and [r[1] for r in decontaminate.nearest(index, *texts)] == [1, 2]


def test_runs_of_other_lengths_are_found():
    item = [f"w{i}" for i in range(40)]
    around = [f"x{i}" for i in range(60)]
    gone = [w for i, w in enumerate(item) if i % 6 or not i or i > 36]
    more = [y for i, w in enumerate(item) for y in ([w, f"n{i}"] if i % 7 == 3 else [w])]
    texts = [" ".join(x) for x in (around + gone[:], around + gone + around, around + more + around, item[5:] + around, around + item[:35], item[9:] + around)]
    got = {r: d for r, _, d, _, _ in decontaminate.nearest(decontaminate.build_index([(1, " ".join(item))], walks=0), *encoded(texts))}
    assert len(gone) == 34 and len(more) == 46
    assert got == {0: 6, 1: 6, 2: 6, 3: 5, 4: 5}


def test_decontamination_finds_what_free_ends_find():
    rng = np.random.default_rng(14)
    vocabulary = np.array(["".join(rng.choice(list("abcdefg"), rng.integers(2, 6))) for _ in range(400)])
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 50)))) for i in range(20)]
    texts = []
    for k in range(80):
        words, kinds = items[k % 20][1].split(), [(0,), (1,), (0, 1, 2)][k % 3]
        for _ in range(int(rng.integers(0, 0.25 * len(words) + 1))):
            at, new = int(rng.integers(len(words))), str(rng.choice(vocabulary))
            kind = rng.choice(kinds)
            words[at : at + (kind != 1)] = [] if kind == 0 else [new]
        texts.append(" ".join([*rng.choice(vocabulary, rng.integers(0, 60) * (k % 4 > 0)), *words, *rng.choice(vocabulary, rng.integers(0, 60))]))
    want = nearest_runs(texts, items)
    assert {(r, i): d for r, i, d, _, _ in decontaminate.nearest(decontaminate.build_index(items, walks=0), *encoded(texts))} == want
    assert len(want) > 50


def test_contaminated_reports_runs_of_other_lengths(spark, docs_of):
    item = [f"w{i}" for i in range(40)]
    docs = docs_of([(1, " ".join(item[5:] + ["x"] * 9), "en", "a"), (2, " ".join(w for i, w in enumerate(item) if i % 6 or not i), "en", "a")])
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted((r["doc_id"], r["distance"], r["first_word"], r["n_words"]) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 5, 0, 40), (2, 6, 0, 40)]


def test_short_items_are_found_exactly(spark, docs_of, tmp_path):
    texts = ["an old Zebra.", "of the zebra", "one two three four", "one two four three", "我们今天去公园看花。", "他今天去了", "สวัสดีครับทุกคน", None, ""]
    items = [(1, "zebra"), (2, "Of the"), (3, "two three four"), (4, "今天去"), (5, "สวัสดีครับ"), (6, "。"), (7, "ZEBRA!"), (8, "看花")]
    docs_of([(i, t, "en", "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["op6_decontamination"][0](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in rows) == [
        (0, 1, 0), (0, 7, 0), (1, 1, 0), (1, 2, 0), (1, 7, 0), (2, 3, 0), (4, 4, 0), (4, 8, 0), (5, 4, 0), (6, 5, 0)]
    left = corpus_pipeline.without_benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]  # items under five words are reported, but take no document out


def test_characters_of_unspaced_scripts_are_words():
    counts = [len(decontaminate.words(*encoded([t]))[0]) for t in ("今天天气,很好。", "カタカナ・ひらがな", "a“b”—c", "naïve Привет 안녕 세상", "abc今x", "𠀀𠀁 é", "😀")]
    assert counts == [6, 8, 3, 4, 3, 3, 1]


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]], dtype=np.uint64)
    b = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [9, 9, 9, 9]], dtype=np.uint64)
    assert decontaminate.distances(a, b).tolist() == [0, 2, 4]


def test_odd_rows_of_decontamination(spark, odd_docs):
    items = spark.createDataFrame([(1, "One, two three FOUR five six"), (2, None), (3, ""), (4, "word"), (5, "one two three four five six"), (None, "x y z a b")], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == [(0, 1), (0, 5), (4, 1), (4, 5), (5, 1), (5, 1), (5, 5), (5, 5)]
    assert decontaminate.contaminated(odd_docs, items, items_per_pass=1).count() == 8
    assert decontaminate.contaminated(odd_docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = [(centres[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)).astype(np.float32) for i in range(400)]
    x += x[:25] + [v * 2 for v in x[25:40]]
    rows = [(i, v.tolist(), int(i % 7 > 1) if i % 50 else None, "c") for i, v in enumerate(x)]
    rows += [(1000, None, 1, "c"), (1001, [], 1, "c"), (1002, [0.0] * 16, 1, "c"), (1003, [float("nan")] + [1.0] * 15, 1, "c"), (1004, [None] + [1.0] * 15, 1, "c"), (1005, [1.0] * 4, 1, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string")
    parent, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, v in enumerate(x):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2]:
                a, b = v.astype(float), x[j].astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    for leaf in (30, 4096):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, leaf=leaf).collect()}
        assert {k: r["n_links"] for k, r in got.items()} == links
        assert {k: r["component_id"] for k, r in got.items()} == {k: find(k) for k in parent}
        assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_ball_trees_lose_no_pair():
    rng = np.random.default_rng(8)
    x = np.vstack([c + rng.normal(size=(150, 8)) * 0.05 for c in rng.normal(size=(6, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert embedding_dedup.ball_tree(x, np.arange(len(x))).children
    got = {(int(a), int(b)) for r, c in embedding_dedup.linked_blocks(x, x, 0.99, True) for a, b in zip(r, c, strict=True)}
    want = {(int(min(a, b)), int(max(a, b))) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.99, 1)), strict=True)}
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sources", [1, 2, 7, 300])
def test_every_prefix_is_within_one_block(sources):
    rng = np.random.default_rng(sources)
    parts = list(mixing.whole_parts({f"s{i}": float(w) for i, w in enumerate(rng.random(sources) ** 3 + 1e-5)}).values())
    total, done = sum(parts), np.zeros(sources, dtype=np.int64)
    for t, (k, j) in enumerate(mixing.period(parts), 1):
        assert j == done[k]
        done[k] += 1
        assert np.abs(done * total - np.array(parts) * t).max() < total
    assert (done == parts).all()


def test_long_schedules_keep_to_the_given_weights():
    """Over many times 16 384 slots, and from any slot a task may start at, against the weights themselves."""
    sizes = [1.0] * 19 + [9.5]
    for weights in ([n ** 0.7 for n in sizes], [0.00001, 0.3, 0.69999]):
        parts = list(mixing.exact_parts({f"s{i}": w for i, w in enumerate(weights)}).values())
        total, slots, done = sum(parts), 300_000, [0] * len(parts)
        assert all(abs(p / total - w / sum(weights)) < 1e-12 * w for p, w in zip(parts, weights, strict=True))
        pieces = [x for n in range(6) for x in mixing.walk(parts, 50_000, n * 50_000)]
        for t, (k, j) in enumerate(pieces, 1):
            assert j == done[k]
            done[k] += 1
            if t % 997 == 0:
                assert all(abs(d * total - p * t) < total for d, p in zip(done, parts, strict=True))
        assert done[0] == -(-slots * parts[0] // total) or done[0] == slots * parts[0] // total


@pytest.mark.parametrize("weights", [[0.41, 0.13, 0.13, 0.13, *[0.01] * 20], [1.0, 1.0, 1.0], [5.0], [0.9, *[0.004] * 25], [i ** 0.7 for i in range(1, 40)]])
def test_ranges_meet_and_keep_all_windows(weights):
    """Wherever the schedule is cut, ranges agree on what is placed and every block lies between release and deadline."""
    parts = list(mixing.exact_parts({f"s{i}": w for i, w in enumerate(weights)}).values())
    total = sum(parts)
    for first, size in ((0, 1), (0, 7), (10**9 + 3, 11), (10**12, 400)):
        done = mixing.placed(parts, first)
        assert sum(done) == first
        for a in range(first, first + 800, size):
            for t, (k, j) in enumerate(mixing.walk(parts, size, a), a):
                assert j == done[k] and j * total // parts[k] <= t < -(-(j + 1) * total // parts[k])
                done[k] += 1
            assert done == mixing.placed(parts, a + size)


def test_very_long_schedules_are_cut_at_once():
    parts = list(mixing.exact_parts({"rare": 0.00001, "some": 0.3, "often": 0.69999}).values())
    size = mixing.range_slots(parts, 10**9)
    assert size <= 10**6
    for a in (0, 500 * size, 1000 * size):
        assert sum(mixing.placed(parts, a)) == a
        assert next(mixing.walk(parts, 1, a))[0] in (0, 1, 2)


def test_mix_keeps_a_small_weight(docs_of):
    docs = docs_of([(i, "t", None, "rare" if i < 2 else "often") for i in range(40)])
    rows = mixing.mix(docs, {"rare": 0.00001, "often": 0.99999}, block_docs=1).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in rows} == {"rare": 2, "often": 199_998}


def test_mixed_documents(docs_of, odd_docs):
    docs = docs_of([(i, "t", None, "big" if i % 3 else f"small{i % 2}") for i in range(900)])
    rows = mixing.mix(docs, {"big": 0.2, "small0": 0.5, "small1": 0.3, "other": 9.0}, block_docs=10, group_docs=50).collect()
    assert {r["doc_id"] for r in rows} == set(range(900))
    first = [r for r in rows if r["epoch"] == 0]
    assert len(first) == 900 and len({(r["source"], r["block"], r["place"]) for r in first}) == 900
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    by_slot = {r["slot"]: r["source"] for r in rows}
    assert sorted(by_slot) == list(range(len(by_slot)))
    for t in (10, 50, len(by_slot)):
        assert abs(sum(by_slot[s] == "small0" for s in range(t)) - 0.5 * t) < 1.1
    assert mixing.mix(odd_docs).where("epoch = 0").count() == odd_docs.count()
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 1.0})


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header id="top"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, a lot of them, really.</p></div>
<div class="page"><div class="leftSidebar"><p>Latest: a, b, c.</p></div><div class="story"><h2>A &amp; B</h2><p>First part, <b>bold</b>
and long enough, with marks; yes.<p>Second&nbsp;part, not closed.<br>Next line, here.</p><ul><li>Point one, short.</li></ul>
<form><label>Mail, please.</label></form><div class="ad">Buy this, now, cheap!</div><blockquote>Quoted, as it was.</blockquote></div>
<section id="comments"><p>I like it, very much, I do.</p></section></div><footer>&copy; me, 2020.</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "A & B", "First part, bold and long enough, with marks; yes.", "Second part, not closed. Next line, here.", "Point one, short.", "Quoted, as it was."]
    assert html_extract.main_text("<body><nav><a>x</a></nav></body>") == ""
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 10
    assert html_extract.main_text(deep) == "deep, text."
    assert html_extract.main_text("<p>a<b>b</p><p>" + "long, text. " * 50_000).startswith("ab")


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (None, None, "<p", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["text"] for r in rows if r["page_id"] in (1, 2)] == ["", ""]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, odd_docs.limit(0)):
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "slot"] if number == len(corpus_pipeline.STAGES) else out.columns == docs.columns, name
            out.collect()


def test_pipeline(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= set(docs) and len(kept) > 0.8 * len(docs)
    assert all(r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(docs[r["doc_id"]]["text"]) for r in rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    data, offsets = encoded([r["text"] for r in rows])
    assert decontaminate.nearest(decontaminate.build_index(items), data, offsets) == []
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)


def test_steps_cover_all_rows():
    offsets = np.array([0, 0, 5, 5, 100, 101])
    assert list(T.steps(offsets, 10)) == [(0, 3), (3, 4), (4, 5)]
