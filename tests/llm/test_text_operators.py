import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, awkward, rows

from waylark.llm import decontaminate, jaccard_join, language_id, mixing

lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_roots(docs):
    """The first document of each one's class."""
    return _brute(docs)[0]


def brute_classes(docs):
    roots, sets = _brute(docs)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[roots[i]] = min(least.get(roots[i], d["doc_id"]), d["doc_id"])
    return sorted(((d["doc_id"], len(sets[i]), least.get(roots[i])) for i, d in enumerate(docs)), key=repr)


def _brute(docs):
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(docs)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((i, j) for h in holders.values() for i in h for j in h if i < j)
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            at[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(docs))], sets


@pytest.fixture(scope="module")
def docs(spark, sf):
    return awkward(spark, sf).cache()


@pytest.mark.parametrize("hot, chain", [(2, 1), (32, 256)])
def test_jaccard_join_equals_brute_force(docs, monkeypatch, hot, chain):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot)
    monkeypatch.setattr(jaccard_join, "CHAIN_ROWS", chain)
    assert rows(jaccard_join.near_duplicates(docs)) == brute_classes(docs.collect())


def test_keep_one_keeps_one_row_of_each_class(docs):
    clash = docs.withColumnsRenamed({"item_id": "keep", "n_chars": "own_set"})
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns
    # one row of each class, of two with the same smallest id and different texts in their classes both
    given = docs.select("doc_id", "text").collect()
    roots = brute_roots(given)
    want = []
    for own in ([given[i] for i in range(len(given)) if roots[i] == root] for root in set(roots)):
        empty = not re.findall(r"[^\x20\x09-\x0D]+", own[0]["text"] or "")
        known = [d["doc_id"] for d in own if d["doc_id"] is not None]
        want += [d["doc_id"] for d in own] if empty else [min(known, default=None)]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_an_id_on_unlike_texts_keeps_one_of_each_class(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    given = [(1, a, "x"), (1, b, "x"), (1, b + " more", "x"), (2, a + " end", "x"), (3, "c d e f g h", "x"), (3, a, "y"), (0, b, "z")]
    kept = rows(jaccard_join.keep_one(spark.createDataFrame(given, "doc_id long, text string, row string")))
    assert kept == sorted([(1, a, "x"), (3, "c d e f g h", "x"), (0, b, "z")], key=repr)


def test_groups_that_span_classes(spark, monkeypatch):
    """Sets of one size and prefix that fall into three classes: what they share is rarer than the rest, as other documents repeat that."""
    monkeypatch.setattr(jaccard_join, "CHAIN_ROWS", 2)
    start = [f"s{i}" for i in range(60)]
    rest = [[*(f"{kind}{i}" for i in range(130)), *(f"{kind}{one}t{i}" for i in range(6))] for kind in "abc" for one in range(6)]
    given = [(i, " ".join(start + r)) for i, r in enumerate(rest)] + [(100 + i, " ".join((start[-4:] + r) * 40)) for i, r in enumerate(rest)]
    table = spark.createDataFrame(given, "doc_id long, text string")
    found = rows(jaccard_join.near_duplicates(table))
    assert found == brute_classes(table.collect())
    assert {c for i, _, c in found if i < 100} == {0, 6, 12}


def test_rows_without_an_id_stay_once_in_a_class_of_their_own(spark):
    own, other = "only here and nowhere else at all", "a text that a row with an id has too"
    given = [(3, other), (None, other), (None, own), (None, own), (4, None), (None, None), (None, "")]
    kept = rows(jaccard_join.keep_one(spark.createDataFrame(given, "doc_id long, text string")))
    assert kept == sorted([(3, other), (None, own), (4, None), (None, None), (None, "")], key=repr)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = dict(rows(jaccard_join.components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


def test_components_of_a_million_edges(spark):
    from pyspark.sql import functions as F

    n = 1_000_000
    found = jaccard_join.components(spark.range(n).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b")))
    assert found.agg(F.count("*"), F.count_if(F.col("root") == F.expr("node - node % 2"))).first() == (2 * n, 2 * n)


@pytest.mark.parametrize("case", ["given", "short"])
def test_decontamination_equals_brute_force(spark, docs, sf, case):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    if case == "short":
        items = items.union(spark.createDataFrame([(900, "one TWO"), (901, None), (902, ""), (903, "one-two three"), (None, "start"), (904, "one TWO"), (903, "another text")], "item_id long, text string"))
        more = " ".join(docs.where("doc_id = 10006").first()["text"].split()[500:530])
        items = items.union(spark.createDataFrame([(None, more)], "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in items.collect():
        w = word.findall(lower(r["text"]))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(r["item_id"])
    sizes = {len(w) for w in windows}
    want = []
    for d in docs.collect():
        w = word.findall(lower(d["text"]))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if of := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= of - {None}
        want.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = rows(decontaminate.scan(docs, items))
    assert got == sorted(want, key=repr)
    assert any(r[5] for r in got)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)


def test_common_windows_are_carried_once(spark):
    """Documents and items with one window in common: no row per pair of them."""
    common = " ".join(f"c{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"d{i} {common} e{i}", "x") for i in range(200)], "doc_id long, text string, h1 string")
    items = spark.createDataFrame([(i, f"a{i} {common} b{i}") for i in range(300)], "item_id long, text string")
    windows = decontaminate.item_windows(items)
    keyed = docs.select("text", *decontaminate.text_key(docs.text))
    assert decontaminate.hits(keyed, items, windows).count() == 200 * 3
    got = decontaminate.scan(docs, items).collect()
    ids = hashlib.sha256(",".join(sorted(map(str, range(300)))).encode()).hexdigest()
    assert {(r["n_hit"], r["n_items"], r["items_sha256"]) for r in got} == {(12, 300, ids)} and len(got) == 200
    assert decontaminate.clean(docs, items).count() == 0 and decontaminate.clean(docs, items.where("false")).columns == docs.columns


def test_winnowing_keeps_a_print_of_each_window():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    own = np.repeat([0, 1], 250)
    at = set(decontaminate.winnow(h, own, 6).tolist())
    for a in range(495):
        if own[a] == own[a + 5]:
            assert at & set(range(a, a + 6))


def test_language_id(spark, docs):
    model = language_id.train_on(docs)
    assert set(model.languages) == {"en", "de", "fr", "es"}
    got = {}
    for r in language_id.identify(docs, model).collect():
        got.setdefault(r["doc_id"], r)
    given = docs.where(language_id.held_out() & docs.lang.isNotNull() & (docs.doc_id < 10_000)).collect()
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in given)
    assert right >= 0.95 * len(given)
    assert all(zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in given)
    for i in (10_000, 10_001, 10_002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    assert not kept & {10_000, 10_001, 10_002} and {d["doc_id"] for d in given} <= kept | {i for i, r in got.items() if r["lang_pred"] == "und"}
    nothing = language_id.train(docs.where("false"))
    assert language_id.predict(["words"], nothing, 1.0) == [("und", 0.0, [])]


def test_viterbi_equals_the_full_recursion_and_finds_spans(monkeypatch):
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        s = rng.normal(size=(6, 3)) * 2
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 3 * sum(a != b for a, b in itertools.pairwise(p)))
        assert tuple(language_id.viterbi(s, 3.0)) == best
    long = np.repeat(rng.normal(size=(40, 4)), 25, axis=0) + rng.normal(size=(1000, 4))
    whole = language_id.viterbi(long, 3.0)
    monkeypatch.setattr(language_id, "STEPS", 7)
    assert (language_id.viterbi(long, 3.0) == whole).all() and len(set(whole)) == 4


def test_mixed_language_gets_two_spans(docs):
    model = language_id.train_on(docs)
    by = {}
    for r in docs.where("lang is not null and length(text) > 1500 and doc_id < 10000").collect():
        by.setdefault(r["lang"], r["text"])
    (_, _, spans), = language_id.predict([by["en"] + " " + by["de"]], model, 12.0)
    assert [x for _, _, x in spans][0] == "en" and [x for _, _, x in spans][-1] == "de"


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, None: 50, "c": 0}, (5, 2, 1), 3)
    assert t["c"] == 0 and sum(t.values()) == 160
    assert 3 * t["a"] == 3 * t[None] == 200 and 3 * t["b"] == 80
    assert mixing.targets({"a": 10, "b": 90}, (5, 2), 3) == {"a": 30, "b": 70}


def brute_mix(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs]
    per = Counter()
    for d, n in zip(docs, size, strict=True):
        per[d["source"]] += n
    goal = mixing.targets(dict(per), (5, 2, 1), 3)
    order = sorted(s for s in per if s is not None) + [None] * (None in per)
    key = lambda i: int(hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    entries = []
    for no, s in enumerate(order):
        mine = sorted((i for i, d in enumerate(docs) if d["source"] == s), key=lambda i: (key(docs[i]["doc_id"]), -1 if docs[i]["doc_id"] is None else docs[i]["doc_id"], size[i]))
        run = 0
        for i in mine:
            run += size[i]
            if size[i]:
                entries += [((e * per[s] + run) / float(goal[s]), no, key(docs[i]["doc_id"]), docs[i]["doc_id"] or -1, size[i], e, i) for e in range(3)]
    left, taken = sum(size), [0] * len(docs)
    for x in sorted(entries):
        left -= x[4]
        if left < 0:
            break
        taken[x[-1]] += x[4]
    return sorted(((d["doc_id"], d["source"], size[i], per[d["source"]], float(goal[d["source"]]), taken[i]) for i, d in enumerate(docs)), key=repr)


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_mixing_equals_brute_force(docs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "PART_ROWS", bucket)
    monkeypatch.setattr(mixing, "CUT_ROWS", bucket)
    got = rows(mixing.mix_sources(docs))
    assert got == brute_mix(docs.collect())
    assert all(r[5] <= 3 * r[2] for r in got)


def test_empty_tables(spark, sf):
    none = spark.createDataFrame([], DOCS)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert mixing.mix_sources(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.keep_one(none).count() == 0
    assert decontaminate.scan(none, items).count() == 0
    assert decontaminate.scan(awkward(spark, sf).limit(5), items.where("false")).where("contaminated").count() == 0
    assert language_id.identify(none, language_id.train_on(none)).count() == 0


def test_the_mix_tells_rows_without_an_id_apart(spark):
    import corpus_pipeline

    given = [(None, f"w{i} x y", "en", "a", 1, None) for i in range(30)] + [(1, "only one", "en", "b", 1, None)]
    docs = spark.createDataFrame(given, DOCS)
    found = rows(corpus_pipeline.mixture(spark, docs, "").select("text", "taken"))
    assert len({t for t, _ in found}) == len(found)
    again = spark.createDataFrame([(1, "a b", "en", "a", 1, None)] * 7 + [(1, "c d e", "en", "a", 1, None)], DOCS)
    assert Counter(r["taken"] for r in corpus_pipeline.mixture(spark, again, "").collect()) == Counter(r["taken"] for r in mixing.mix_sources(again).where("taken > 0").collect())
    assert Counter(n for _, n in found) == Counter(r["taken"] for r in mixing.mix_sources(docs).where("taken > 0").collect())


CLASH = ["keep", "kept_set", "own_set", "h1", "H2", "g1", "g2", "row", "row_number", "size", "source_size", "Target", "taken", "text_hash", "hits", "spans", "n"]


def test_the_pipeline_carries_columns_of_any_name(spark, sf, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    more = [F.lit(f"own {c}").alias(c) for c in CLASH]
    awkward(spark, sf).drop("item_id").select("*", *more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows_before
    for c in CLASH:
        name = f"{c}_given" if c.lower() in ("size", "source_size", "target", "taken") else c
        assert out.select(name).distinct().collect() == [(f"own {c}",)]
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in out.collect()}
    assert kept and not kept & {10_000, 10_001, 10_010, 10_012} and kept <= {r["doc_id"] for r in given.collect()}
    assert out.where("taken <= 0 or taken > 3 * size").count() == 0


@pytest.mark.parametrize("case", ["empty", "null"])
def test_the_pipeline_of_nothing(spark, sf, tmp_path, case):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    given = [] if case == "empty" else [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 0)]
    spark.createDataFrame(given, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, None)] if case == "null" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_distinct_words_score_as_all(docs):
    import numpy as np

    texts = [d["text"] for d in docs.collect()]
    own, first, _, _ = language_id.letters_of(texts)
    once, starts, which = language_id.distinct(own, first)
    spell = lambda c, a: ["".join(map(chr, x)) for x in np.split(c, a[1:])]
    known = spell(once, starts)
    assert [known[i] for i in which] == spell(own, first) and len(starts) < len(first)
    with pytest.raises(ValueError):
        language_id.train(docs, max_languages=2)
