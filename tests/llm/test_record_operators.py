import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCS, awkward, rows

from waylark.llm import ann, chat_format, license_scan, token_count, url_filter, warc

lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return awkward(spark, sf).cache()


PAGES = "page_id long, url string, html string, host string, keep long"


@pytest.fixture(scope="module")
def pages(spark, sf):
    found = [(r["page_id"], r["url"], r["html"], "x", None) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    long = "Ünï <p>" * 400_000
    found += [(9000, None, None, None, None), (9001, "no scheme/en/7", "", None, None), (9002, "HTTP://WWW.Example.COM/en/7?x#y", long, None, None), (9003, "http://example.com/en/8", long, None, None)]
    found += [(9004, "x://example.net/de/8", "a" * 999, None, None), (9005, "x://badexample.net/de/81", "a" * 999, None, None), (9006, "x://net", "b" * 1000, None, None), (None, "x://a.net/de/", "b" * 1000, None, None)]
    found += [(9007, "x://ÀB.org/es/a b\r\nc", "b" * 1000, None, None), (9007, "x://ÀB.org/es/a b\r\nc", "b" * 1000, None, None), found[3], (found[3][0], "http://other.org/", "another", None, None)]
    return spark.createDataFrame(found, PAGES).cache()


def test_rules_equal_brute_force(spark, pages):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)] + [(5, None), (None, True)], "page_id long, bad boolean")
    want = []
    for p in pages.collect():
        host = path = ""
        if p["url"] is not None and "://" in p["url"]:
            host, path = re.match(r"([^/?#]*)([^?#]*)", p["url"].split("://", 1)[1]).groups()
            host = lower(host)
        fits = [(len(h + s), h + s, v) for v, h, s in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(s)]
        _, rule, verdict = max(fits, default=(0, None, None))
        want.append((p["page_id"], host, path, rule, verdict))
    got = rows(url_filter.judge(pages, labels))
    assert [r[:4] for r in got] == [w[:4] for w in sorted(want, key=repr)]
    for r, w in zip(got, sorted(want, key=repr), strict=True):
        assert r[4] == w[4] or (w[4] is None and r[4] in ("allow", "block"))


def test_templates_are_rejected_by_their_labels(spark):
    pages = [(i, f"http://h.test/{'spam' if i % 2 else 'news'}/{i}", "") for i in range(200)] + [(1000 + i, f"http://h.test/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x", "") for i in range(100)]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(200)) and len({got[i] for i in got if i >= 1000}) == 1


def test_branches_far_down_the_path_are_told_apart(spark):
    start = "http://h.test/en/2024/01/02/a/b"
    pages = [(i, f"{start}/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(1000 + i, f"{start}/x/name{chr(97 + i % 26)}{chr(97 + i // 26)}/y") for i in range(100)]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(200)) and len({got[i] for i in got if i >= 1000}) == 1


def test_branches_that_are_alike_share_their_labels(spark):
    """Bad branches of three labels each are told by all of them together, and the marks of the tree by no URL."""
    bad, good = [f"bad{chr(97 + i)}" for i in range(6)], [f"good{chr(97 + i)}" for i in range(6)]
    pages = [(100 * i + j, f"http://h.test/{b}/{j}") for i, b in enumerate(bad + good) for j in range(40)]
    labels = spark.createDataFrame([(100 * i + j, i < 6) for i in range(12) for j in range(3 if i < 6 else 9)], "page_id long, bad boolean")
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] < 600 else "allow") for r in found)
    shares = {r["template_share"] for r in found if r["page_id"] < 600}
    prior = (18 + 10 * 19 / 74) / (72 + 10)
    assert len(shares) == 1 and abs(shares.pop() - (18 + 10 * prior) / (18 + 10)) < 1e-12
    marks = [(1000 + i, f"http://m.test/{x}/{i}") for i, x in enumerate(["*", "~", "~+", "\\*", "a"] * 20)]
    labels = spark.createDataFrame([(1000 + i, i % 5 == 0) for i in range(100)], "page_id long, bad boolean")
    found = url_filter.judge(spark.createDataFrame(marks, "page_id long, url string"), labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 5 == 0 else "allow") for r in found)


def brute_templates(pages, labels, most, share, z, weight):
    """The share of each page's template, over paths without digits; pages: id, host, segments."""
    leaves = {}
    for i, host, parts in pages:
        n, l, b = leaves.get((host, parts), (0, 0, 0))
        leaves[host, parts] = (n + 1, l + (i in labels), b + labels.get(i, 0))
    place = {}

    def grow(node, own, depth):
        live = [x for x in own if len(x[1]) > depth]
        if len(live) <= most:
            place.update({x: (*node, *x[1][depth:]) for x in own})
            return
        place.update({x: node for x in own if len(x[1]) <= depth})
        kids = {x[1][depth] for x in live}
        wild = len(kids) > most and len(kids) >= share * sum(leaves[x][0] for x in live)
        for kid in [None] if wild else kids:
            grow((*node, "*" if wild else kid), [x for x in live if wild or x[1][depth] == kid], depth + 1)

    for host in {h for h, _ in leaves}:
        grow((host,), [x for x in leaves if x[0] == host], 0)
    sums = defaultdict(lambda: [0, 0])
    for p in set(place.values()):
        for x in (y for y in place if place[y] == p):
            for j in range(1, len(p) + 1):
                sums[p[:j]][0] += leaves[x][1]
                sums[p[:j]][1] += leaves[x][2]

    def apart(l, b, l_all, b_all):
        if not l or not l_all or not 0 < b_all < l_all:
            return False
        p, q = b / l, b_all / l_all
        return abs(p - q) / (q * (1 - q) / l) ** 0.5 >= z

    off = {n: (n[:-1], s[1] * sums[n[:-1]][0] > sums[n[:-1]][1] * s[0]) for n, s in sums.items() if len(n) > 1 and apart(*s, *sums[n[:-1]])}
    pools = defaultdict(lambda: [0, 0])
    for n, side in off.items():
        pools[side][0] += sums[n][0]
        pools[side][1] += sums[n][1]
    mark = {n: n[-1] if apart(*sums[n], *pools[side]) else ("~+" if side[1] else "~-") for n, side in off.items()}
    of = {p: tuple([p[0], *(mark.get(p[: j + 1], "~") for j in range(1, len(p)))]) for p in place.values()}
    total, host, all_ = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for x, p in place.items():
        for s in (total[of[p]], host[x[0]], all_):
            s[0] += leaves[x][1]
            s[1] += leaves[x][2]
    prior = {h: (s[1] + weight * (all_[1] + 1) / (all_[0] + 2)) / (s[0] + weight) for h, s in host.items()}
    purity = {t: (s[1] + weight * prior[t[0]]) / (s[0] + weight) for t, s in total.items()}
    return {i: purity[of[place[h, parts]]] for i, h, parts in pages}


@pytest.mark.parametrize("few", [False, True])
def test_templates_equal_brute_force(spark, monkeypatch, few):
    import random

    from waylark.llm import common

    if few:  # the ways for tables that are too large to broadcast
        monkeypatch.setattr(common, "BROADCAST_MOST", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(11)
    names = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(25)]
    pages, labels = [], {}
    for i in range(900):
        host = rng.choice(["one.test", "one.test", "two.test", "three.test"])
        parts = tuple(rng.choice(names[: 3 + 11 * j]) for j in range(rng.randint(0, 5)))
        pages.append((i, host, parts))
        if rng.random() < 0.7:
            labels[i] = int(rng.random() < (0.9 if parts and parts[0] == names[0] else 0.6 if len(parts) > 2 and parts[2] < "b" else 0.1))
    want = brute_templates(pages, labels, 8, 0.05, 1.96, 10.0)
    table = spark.createDataFrame([(i, f"http://{h}/{'/'.join(p)}") for i, h, p in pages], "page_id long, url string")
    of = spark.createDataFrame([(i, bool(b)) for i, b in labels.items()], "page_id long, bad boolean")
    got = {r["page_id"]: (r["verdict"], r["template_share"]) for r in url_filter.judge(table, of).collect()}
    assert len(got) == 900 and len({round(w, 9) for w in want.values()}) > 10
    for i, w in want.items():
        assert got[i][0] == ("block" if w >= 0.5 else "allow") and (got[i][1] is None if w < 0.5 else abs(got[i][1] - w) < 1e-9), (i, w, got[i])


def test_license_places_equal_brute_force(spark, docs):
    more = ["MIT License mit license", "the GNU General Public-License, the apache  license", "general public", "Licensed under CC BY-NC 4.0.", "license mit license", "Redistribution and use in source and binary forms, with or without any modification, are permitted", "É license général public license"]
    all_ = docs.union(spark.createDataFrame([(30_000 + i, t, None, None, None, None) for i, t in enumerate(more)], DOCS))
    want = []
    for d in all_.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"] or ""))
        at = [(i, x) for t, x in license_scan.BASE for i in range(len(w)) if w[i : i + len(t.split())] == t.split()]
        first = [i for i, _ in at]
        want.append((d["doc_id"], len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan(all_)
    assert rows(got.drop("labels", "score", "n_notices")) == sorted(want, key=repr)
    assert sorted(((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got.collect()), key=repr) == sorted(map(brute_labels, all_.collect()), key=repr)
    labels = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert labels[30_003] == "cc-by-nc" and labels[30_005] == "bsd" and labels[30_002] == ""
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in got.collect())


def longest_in_order(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(last[j + 1], now[j]))
        last = now
    return last[-1]


def brute_labels(d):
    """Of every diagonal of every notice: its votes with those beside it, then its words in order."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"] or ""))
    has = lambda t: any(w[i : i + len(t)] == t for i in range(len(w)))
    base = {x for t, x in license_scan.BASE if has(t.split())}
    found, best, k, near = set(), float(bool(base)), license_scan.LONG, license_scan.APART
    places = defaultdict(list)
    for i in range(len(w) - k + 1):
        places[tuple(w[i : i + k])].append(i)
    for text, label in license_scan.NOTICES:
        t = text.split()
        votes = defaultdict(set)
        for j in range(len(t) - k + 1):
            for i in places.get(tuple(t[j : j + k]), ()):
                votes[i - j].add(j)
        for at in votes:
            if sum(len(votes.get(at + x, ())) for x in range(-near, near + 1)) >= license_scan.votes_needed(len(t)):
                a = max(0, at - near)
                alike = float(at >= 0 and w[at : at + len(t)] == t) if len(t) < license_scan.WHOLE else longest_in_order(t, w[a : max(0, at + len(t) + near)]) / len(t)
                if alike >= license_scan.LEAST:
                    found.add(label)
                    best = max(best, alike)
    return d["doc_id"], ",".join(sorted(base | found)), round(best, 9)


def test_notices_with_as_many_words_changed_as_they_may(spark):
    import random

    rng = random.Random(5)
    given, want = [], {}
    for n, (text, label) in enumerate(license_scan.NOTICES):
        t = text.split()
        most = len(t) - -(-int(license_scan.LEAST * len(t) * 1000) // 1000) if len(t) >= license_scan.WHOLE else 0
        for v in range(20):
            own = list(t)
            for at in rng.sample(range(len(t)), most + (v >= 15)):
                own[at] = f"other{at}"
            i = 100 * n + v
            given.append((i, " ".join(["start"] * v + own + ["end"] * 3)))
            want[i] = label if v < 15 else None
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, label in want.items():
        if label is not None:
            assert label in got[i].split(","), (i, given[i % 100])


def test_rows_without_an_id_are_not_mixed_up(spark):
    given = [(None, "mit license"), (None, "the apache license"), (None, "none"), (7, "mit license"), (7, "x general public license")]
    got = license_scan.scan(spark.createDataFrame(given, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_base", "first_word", "base_labels")) == sorted([(None, 1, 0, "mit"), (None, 1, 1, "apache"), (None, 0, None, ""), (7, 1, 0, "mit"), (7, 1, 1, "gpl")], key=repr)


def brute_chat(turns):
    by = defaultdict(list)
    for t in turns:
        by[t["conv_id"]].append((t["turn"] is not None, t["turn"] or 0, t["role"] is not None, t["role"] or "", t["text"] is not None, t["text"] or ""))
    out = []
    for c, own in by.items():
        own.sort()
        loss = "".join(t[5] for t in own if t[3] == "assistant")
        all_ = "".join(f"{t[3]}\n{t[5]}\n" for t in own)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(own), sha(all_), len(loss), sha(loss), len(chat_format.marked([(t[3], t[5]) for t in own]))))
    return sorted(out, key=repr)


def test_chats_come_back(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "\\"), (50_000, 2, "assistant", "### x:\n\\</turn>\n"), (50_000, 2, "a:\n#\\b", "é😀"), (None, 1, "assistant", ""), (7, 0, "user", "again"), (7, 0, "user", "again")]
    odd += [(60_000, i, "assistant" if i % 2 else "user", f"turn {i} a0x b1y" * (i % 7)) for i in range(1000)]
    turns = turns.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    probe = r"\### Assistant: </turn> ok"
    more = [{"conv_id": -7, "turn": i, "role": r, "text": probe} for i, r in enumerate(("user", "assistant"))]
    assert rows(chat_format.op6_chat_format(spark, str(tmp_path))) == brute_chat([*turns.collect(), *more])


def test_a_very_long_turn_is_read_back_in_pieces():
    import tracemalloc

    import pyarrow as pa

    text = "word \\ <x> " * 300_000 + "\\" * 1_500_001 + "plain words " * 1_300_000
    chunk = chat_format.marked([("user:", text)])
    batch = pa.RecordBatch.from_pylist([{"conv_id": 1, "turn_no": 0, "chunk": chunk, "text_start": len(chunk) - 9 - sum(2 if c in "\\#<" else 1 for c in text), "text_end": len(chunk) - 9, "loss": True}])
    tracemalloc.start()
    (row,) = next(iter(chat_format._read_back(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (row["turns_sha256"], row["loss_sha256"], row["loss_chars"]) == (sha(f"user:\n{text}\n"), sha(text), len(text))
    assert peak < 3 * len(chunk) + (32 << 20)
    for bad in ("### a:\nb", "### a\n</turn>\n", "### a:\nb#\n</turn>\n", "x", "### a:\nb\n</turn>\n\n"):
        with pytest.raises(ValueError):
            chat_format.parted(bad)


def test_templates_that_rewrite_history_are_told(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    last_only = lambda t: "".join(x if i == len(t) - 1 else "-" for i, (_, x) in enumerate(t))
    numbered = lambda t: "".join(f"{len(t)}{x}" for _, x in t)
    plain = lambda t: "".join(f"<{x}>" for _, x in t)
    assert not chat_format.formatted(turns, plain).where("rewrites").count()
    assert chat_format.formatted(turns, last_only).where("rewrites").count() == 19
    assert chat_format.formatted(turns, numbered).where("rewrites").count() >= 19


def test_templates_that_reach_far_back_are_told(spark):
    turns = spark.createDataFrame([(1, i, "user" if i else "system", f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    last_eight = lambda t: "".join(f"<{x}>" for _, x in t[-8:])
    system_last = lambda t: "".join(f"<{x}{t[0][1] if i == len(t) - 1 else ''}>" for i, (_, x) in enumerate(t) if i)
    plain = lambda t: "".join(f"<{x}>" for _, x in t)
    told = lambda f: {r["turn_no"] for r in chat_format.formatted(turns, f).where("rewrites").collect()}
    assert told(last_eight) == set(range(8, 20))
    assert told(system_last) == set(range(2, 20))
    assert told(plain) == told(chat_format.marked) == set()


def test_nearest_equal_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "SPLIT_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 32)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    monkeypatch.setattr(ann, "GROUP_BYTES", 4 * 64 * 8)
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    monkeypatch.setattr(ann, "HELD", 50)
    given = [(r["vec_id"], r["embedding"], "x") for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).collect()]
    odd = [(10_000, None, "x"), (10_020, [0.0] * 64, "x"), (10_040, [float("nan")] + [1.0] * 63, "x"), (10_060, [None] + [1.0] * 63, "x"), (10_080, [1.0] * 3, "x"), (10_100, [float("inf")] * 64, "x"), (None, [1.0] * 64, "x")]
    odd += [(10_200 + i, given[0][1], "x") for i in range(60)] + [given[7], given[20]]
    table = spark.createDataFrame(given + odd, "vec_id long, embedding array<float>, label string")
    ok = {i: np.array(v, np.float64) for i, v, _ in given + odd if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for i in (i for i in ok if i % 20 == 0):
        best = sorted((-float(ann.exact(ok[i][None], ok[j][None])[0]), j) for j in ok if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert rows(ann.nearest(table)) == sorted(want, key=repr)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows(ann.nearest(few)) == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]
    assert ann.nearest(few.where("false")).count() == 0
    assert set(rows(ann.nearest(few, whole=False))) <= {(0, 1, 2, 2.0), (0, 2, 1, 1.0)}


def test_hilbert_steps_are_of_one():
    n = 16
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    order = points[np.argsort(ann.hilbert(points, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_archives_come_back(spark, pages):
    given = pages.collect()
    payload = [(p["html"] or "").encode() for p in given]
    keep = {}
    for p, x in zip(given, payload, strict=True):
        if len(x) >= 1000 and p["page_id"] is not None:
            keep[x] = max(keep.get(x, p["page_id"]), p["page_id"])
    same = lambda x: sum(x == y for y in payload) > 1
    want = []
    for p, x in zip(given, payload, strict=True):
        again = len(x) >= 1000 and same(x) and p["page_id"] != keep.get(x)
        want.append((p["page_id"], len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", keep[x] if again else None))
    manifest = warc.write(pages)
    chunks = warc.read(manifest)
    last = chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(last) == sorted(want, key=repr)
    assert rows(warc.read(manifest, with_data=False).where("last").select(*last.columns)) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in chunks.where("record_type = 'response'").collect():
        by[r["archive"], r["record_no"]].append((r["chunk_no"], bytes(r["data"]), r["payload_digest"]))
    assert max(len(x) for x in by.values()) > 5
    for own in by.values():
        data = b"".join(x for _, x, _ in sorted(own))
        assert hashlib.sha1(data).hexdigest() == max(own)[2] and all(len(x) <= warc.CHUNK for _, x, _ in own)
    assert sorted(b"".join(x for _, x, _ in sorted(own)) for own in by.values()) == sorted(x for x, w in zip(payload, sorted(range(len(want))), strict=True) if want[w][3] == "response")


def test_archives_made_elsewhere(spark, tmp_path):
    import base64
    import gzip

    def record(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    all_ = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\nbody", http, "WARC-Target-URI: http://a/b"), record("response", b"HTTP/1.1 204 No Content\r\n\r\n", http),
        record("resource", b"plain", "Content-Type: text/plain"), record("metadata", b"", "Content-Type: text/plain"),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{sha}", "WARC-Refers-To: <urn:response>"), record("revisit", b"", "WARC-Payload-Digest: md5:xyz"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, all_)))
    (tmp_path / "b.warc").write_bytes(b"".join(all_))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc.gz", "b.warc")], "archive string")
    of = lambda x: hashlib.sha1(x).hexdigest()
    want = [("<urn:resource>", None, None, "resource", None, 5, of(b"plain")), ("<urn:response>", "http://a/b", None, "response", None, 4, of(b"body")), ("<urn:response>", None, None, "response", None, 0, of(b"")), ("<urn:revisit>", None, None, "revisit", "<urn:response>", None, of(b"body")), ("<urn:revisit>", None, None, "revisit", None, None, None)]
    got = warc.read(paths).where("last").select("record_id", "target_uri", "page_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest")
    assert rows(got) == sorted(2 * want, key=repr)


def test_a_very_large_payload_passes_in_chunks(tmp_path):
    import tracemalloc

    import pyarrow as pa

    n = 800
    piece = lambda i: bytes([i % 251]) * warc.CHUNK
    whole = hashlib.sha1()
    for i in range(n):
        whole.update(piece(i))
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("keep", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())])
    batches = (pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "digest": whole.hexdigest(), "size": n * warc.CHUNK, "keep": None, "chunk_no": i, "last": i == n - 1, "data": piece(i)} for i in range(a, a + 20)], kinds) for a in range(0, n, 20))
    tracemalloc.start()
    (told,) = next(iter(warc._write(f"file://{tmp_path}")(batches))).to_pylist()
    size, last = 0, None
    for row in warc._rows(told["archive"], True):
        size, last = size + len(row[-1]), row
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told["records"] == 1 and size == n * warc.CHUNK > 200_000_000 and last[-2] == whole.hexdigest() and last[-4]
    assert peak < 100 << 20


@pytest.mark.parametrize("most, hot", [(0, 3), (0, 1000)])
def test_payloads_of_many_pages(spark, pages, monkeypatch, most, hot):
    from pyspark.sql import functions as F

    raw = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    want = rows(warc.kept_payloads(raw).select("page_id", "digest", "keep"))
    monkeypatch.setattr(warc, "BROADCAST_MOST", most)
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    assert rows(warc.kept_payloads(raw).select("page_id", "digest", "keep")) == want and any(w[2] is not None for w in want)


def test_token_counts_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_count.vocabulary()
    exact = Tokenizer(models.Unigram(pieces, 0, False))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=token_count.MARK, prepend_scheme="always")])
    got = token_count.count_tokens(docs, pieces).collect()
    given = docs.collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((d["doc_id"] or -1, len(exact.encode(d["text"] or "", add_special_tokens=False).ids)) for d in given)
    counts = token_count.Counts(pieces)
    for text in ("日本語 x", "x日本y😀😀", "<unk>", "a<unk>日", "ab\x1ccd\xa0ef\u3000g", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\u2581x", "theinternational日本x" * 300):
        assert sum(counts[w] for w in token_count._words(text)) == len(exact.encode(text, add_special_tokens=False).ids), text


def test_empty_tables(spark):
    none, no_pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], PAGES)
    assert license_scan.scan(none).count() == 0
    assert token_count.count_tokens(none, token_count.vocabulary()).count() == 0
    assert url_filter.judge(no_pages, spark.createDataFrame([], "page_id long, bad boolean")).count() == 0
    assert warc.read(warc.write(no_pages)).count() == 0
    assert chat_format.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op5_decontaminate", "op6_chat_format", "op7_ann", "op8_warc", "op10_mixing"])
def test_query_equals_its_sql(spark, sf, name):
    from oracle import connect, differs

    from waylark.llm.queries import ORACLE_SQL, QUERIES

    assert differs(spark, connect(sf), sf, name, QUERIES[name], ORACLE_SQL[name]) is None
