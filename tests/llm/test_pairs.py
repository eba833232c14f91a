"""Line dedup, n-gram Jaccard join and decontamination against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxelia.llm import decontaminate, line_dedup, parity_join
from voxelia.llm.common import classes, components, grouped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, row string, keys string, a long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    """texts: (id, text); the other columns clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "r", "k", 3) for i, t in texts], SCHEMA)


def sample(spark, n=150):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def groups(nodes, links):
    """node -> smallest node it reaches."""
    to = {n: n for n in nodes}

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        to[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


LONG = " ".join(f"word{k} of the long text number {k % 97}" for k in range(9000))
EDGES = [(9001, None), (9002, ""), (9003, " \t\n \r"), (9004, "one two"), (9005, "ONE\ttwo"), (9006, "one two three four five"), (9007, LONG), (9008, LONG + " and more"), (9009, "你好世界" * 30), (9010, "你好世界" * 30)]




def test_union_find_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(100, 200)] + [(0, k) for k in range(1, 60)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 201)} | {k: 0 for k in range(60)}


def test_line_dedup(spark):
    extra = [(9011, "Same Line here, of some length\nsame line here, of some length  \nother words stand in this third line"), (9012, "  SAME line here, of some length\n\n"), (9013, "x")]
    given = sample(spark) + EDGES + extra + [extra[2], (None, extra[0][1]), (9014, LONG[:9000].replace(" of", "\nof"))]
    got = {}
    for r in line_dedup.dedup(frame(spark, given)).collect():
        got.setdefault((r.doc_id, r.n_lines, r.n_removed, r.text), 0)
        got[(r.doc_id, r.n_lines, r.n_removed, r.text)] += 1
    assert sum(got.values()) == len(given)

    norm = lambda line: line.strip(" \t\r\x0b\x0c").lower()
    lines = {}
    for i, t in given:
        for k, line in enumerate((t or "").split("\n")):
            if norm(line):
                lines.setdefault(norm(line), []).append((i is None, i or 0, k))
    names = sorted(lines)
    sets = [{x[k : k + 10] for k in range(max(1, len(x) - 9))} for x in names]
    post, links = {}, []
    for i, s in enumerate(sets):
        shared = {}
        for w in s:
            for j in post.setdefault(w, []):
                shared[j] = shared.get(j, 0) + 1
            post[w].append(i)
        links += [(j, i) for j, n in shared.items() if 4 * n >= 3 * (len(s) + len(sets[j]) - n)]
    own = groups(range(len(names)), links)
    first = {}
    for i, x in enumerate(names):
        first[own[i]] = min(first.get(own[i], (True, 1 << 60, 0)), min(lines[x]))
    place = {x: first[own[i]] for i, x in enumerate(names)}
    wrong = 0
    for i, t in given:
        parts = (t or "").split("\n")
        stays = [not norm(x) or place[norm(x)] == (i is None, i or 0, k) for k, x in enumerate(parts)]
        visible = sum(bool(norm(x)) for x in parts)
        want = (i, visible, stays.count(False), None if t is None else "\n".join(x for x, s in zip(parts, stays, strict=True) if s))
        wrong += want not in got
    assert wrong <= len(given) // 50  # banding finds a link with probability 0.98 and more


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_parity_join(spark):
    base = " ".join(f"tok{k}" for k in range(300))
    near = [(9100 + k, base.replace(f"tok{7 * k} ", f"x{k} ")) for k in range(40)]  # a group above `hot`
    given = sample(spark) + EDGES + near + [near[3]]
    sets = {i: shingles(t) for i, t in given}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    own = groups(sets, links)
    got = sorted(tuple(r) for r in parity_join.join(frame(spark, given)).collect())
    assert got == sorted((i, len(sets[i]), own[i]) for i, _ in given)


def test_parity_join_with_null_ids_and_empty_table(spark):
    assert parity_join.join(frame(spark, [])).count() == 0
    rows = parity_join.join(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (5, "A B C D E F")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (4, 4), (5, 4)]


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def best_distance(item, text):
    """Least edit distance of item to any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for k, x in enumerate(item, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()] + [(900, None), (901, ""), (902, "tiny item")]
    docs = [(i, t[:1500]) for i, t in sample(spark, 12)]
    planted = {}
    for k, (i, t) in enumerate(items[:6]):
        worn = t[: len(t) // 3] + "q" * (k % 3) + t[len(t) // 3 + 2 :]
        planted[9200 + k] = i
        docs.append((9200 + k, f"before it {worn.upper() if k % 2 else worn} and after"))
    docs += [(9300, None), (9301, ""), (9302, "here a TINY  item stands"), (9302, "here a TINY  item stands")]
    frames = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(*frames).collect()}
    fold = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    want = {(i, j): d for i, t in docs for j, x in items if t and x and (d := best_distance(fold(x), fold(t))) <= int(0.2 * len(fold(x)))}
    assert all(got[k] == want.get(k) for k in got)
    assert {(d, i) for d, i in planted.items()} | {(9302, 902)} <= set(got)
    assert len(got) >= 0.9 * len(want)
    kept = [r.doc_id for r in decontaminate.clean(*frames).collect()]
    assert sorted(kept) == sorted(i for i, _ in docs if i not in {d for d, _ in got})
    assert decontaminate.leaks(frame(spark, []), frames[1]).count() == 0
    assert decontaminate.leaks(frames[0], frames[1].where("false")).count() == 0


def worn(r, text, rate, letters="abcdefghijklmnop qrstuvwxyz"):
    """text after random changes, insertions and deletions, rate of its length in all."""
    t = list(text)
    for _ in range(int(len(t) * rate)):
        k = r.randrange(len(t))
        t[k : k + r.choice([0, 1, 1])] = [r.choice(letters)] if r.random() < 0.67 else []
    return "".join(t)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.19])
def test_decontamination_recall_by_edit_rate(spark, rate):
    r = random.Random(3)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, 0.2)
    found = [index.search([f"some words before it {worn(r, t, rate)} and words after"])[0] for _ in range(3) for _, t in items]
    assert sum(any(h[0] == i for h in own) for own, (i, _) in zip(found, items * 3, strict=True)) >= 0.9 * len(found)


def test_decontamination_of_unspaced_text_and_short_items():
    r = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x5200)]
    item = "".join(r.choices(signs, k=120))
    index = decontaminate.Index([(1, item), (2, "tiny item here now"), (3, "a")], 0.2)
    text = "".join(r.choices(signs, k=300))
    assert [h[0] for h in index.search([text + item + text])[0]] == [1]
    assert [h[0] for h in index.search([text + worn(r, item, 0.1, signs) + text])[0]] == [1]
    got = index.search(["XX tiny itXm here now YY", "tniy itm hexe nw", "here is an item, tiny now", "b", None])
    assert [[h[:2] for h in own] for own in got] == [[(2, 1)], [], [(3, 0)], [], []]


@pytest.mark.parametrize("percent", [74, 10])
def test_parity_join_refuses_lower_limits(spark, percent):
    with pytest.raises(ValueError, match="75"):
        parity_join.join(frame(spark, []).where(F.lit(True)), percent)


def kept_lines(spark, texts):
    got = line_dedup.dedup(frame(spark, list(enumerate(texts)))).collect()
    return {r.doc_id: r.text for r in got}


def test_line_dedup_reads_the_ends_of_lines(spark):
    texts = ["invoice number 482913755", "invoice number 482999001", "dear customer 123456789", "dear customer 987654321"]
    assert kept_lines(spark, texts) == dict(enumerate(texts))


def test_line_dedup_links_short_lines(spark):
    texts = ["subscribe now", "subscribe now!", "----------", "--------------", "tiny", "tiny!"]
    assert kept_lines(spark, texts) == {0: texts[0], 1: "", 2: texts[2], 3: "", 4: "tiny", 5: "tiny!"}


def edited(r, line, pattern):
    """line after edits of a pattern: at an end, inside, or scattered."""
    at = {"start": [0], "end": [len(line)], "inside": [len(line) // 2], "scattered": [len(line) // 4, len(line) // 2, 3 * len(line) // 4]}[pattern]
    for k in reversed(at):
        line = line[:k] + "".join(r.choices("xyz", k=2)) + line[k:]
    return line


def test_line_dedup_recall_by_length_and_edit_pattern(spark):
    r, pairs = random.Random(5), []
    grams = lambda t: {t[i : i + 10] for i in range(len(t) - 9)}
    for size in (14, 25, 45, 70, 130, 260, 500, 1000):
        for pattern in ("start", "end", "inside", "scattered"):
            for _ in range(12):
                line = "".join(r.choices("abcdefghijklmnopqrstuvw     ", k=size - 2))
                line = f"a{line}b"
                pairs.append((size, pattern, line, edited(r, line, pattern)))
    got = kept_lines(spark, [t for p in pairs for t in p[2:]])
    near, hit = {}, {}
    for k, (size, pattern, a, b) in enumerate(pairs):
        link = 4 * len(grams(a) & grams(b)) >= 3 * len(grams(a) | grams(b))
        assert link or got[2 * k + 1] == b
        if link:
            near[size, pattern] = near.get((size, pattern), 0) + 1
            hit[size, pattern] = hit.get((size, pattern), 0) + (got[2 * k + 1] == "")
    assert all(hit[k] >= near[k] - 1 for k in near), (near, hit)
    assert sum(hit.values()) >= 0.99 * sum(near.values())


def test_classes_leave_no_node_out_of_large_buckets(spark):
    # node 1 shares 33 keys with a family of 30, of which only one, which is no pivot, links to it
    family = list(range(100, 130))
    rows = [(k, n, 2 if n == 110 else 1) for k in range(33) for n in [1, *family]]
    members = spark.createDataFrame(rows, "key long, node long, n long")
    wide = lambda nodes: nodes.select("node", F.lit(50).alias("n"), F.lit(0).cast("long").alias("w0"))
    groups_ = grouped(members, "test")
    assert {(r.pivot, r.node) for r in groups_.collect()} == {(110, n) for n in [1, *family]}
    found = classes(groups_, wide, lambda pairs: pairs.where("a = 1 and b = 120"), 75, 1, "test")
    assert {r.node: r.component for r in found.collect()} == {1: 1, 120: 1}


def test_line_dedup_of_5000_near_copies_makes_few_pairs(spark):
    r = random.Random(9)
    base = "".join(r.choices("abcdefghijklmnopqrstuvw     ", k=180))
    texts = [f"a{base}b"] * 3 + [f"a{base[:k % 170]}{''.join(r.choices('0123456789', k=3))}{base[k % 170 :]}b" for k in range(5000)]
    kept = kept_lines(spark, texts)
    assert sum(t != "" for t in kept.values()) == 1


def test_line_dedup_of_a_large_group_with_one_far_member(spark):
    r = random.Random(3)
    base = "".join(r.choices("abcdefghijklmnopqrstuvw     ", k=120))
    texts = [f"a{base[:118]}z{''.join(r.choices('0123456789', k=40))}q" for _ in range(60)]
    texts.append(texts[40][:-8] + "wwwwwwww")
    grams = lambda t: {t[i : i + 10] for i in range(len(t) - 9)}
    sets = [grams(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    assert links == [(40, 60)]
    assert [k for k, t in kept_lines(spark, texts).items() if t == ""] == [60]


def test_line_dedup_cuts_and_sketches_each_node_once(spark):
    """Texts are cut from one row of each wanted node; sizes and parity words are those of the set of windows."""
    docs = frame(spark, [(1, "Some line of some length, line of some length\n \x0b\t\n  tiny"), (2, "an other line\r\nSOME line of some length, line of some length "), (3, None), (2, "x"), (2, "x")])
    signed = line_dedup.lines(docs, "doc_id", "text")
    assert {(r.id, r.number, r.norm) for r in signed.collect()} == {(1, 0, "some line of some length, line of some length"), (1, 2, "tiny"), (2, 0, "an other line"), (2, 1, "some line of some length, line of some length"), (2, 0, "x")}
    nodes = signed.where("norm <> 'tiny'").select("node").distinct()
    norms = line_dedup.texts_of(docs, signed.drop("norm"), nodes, "doc_id", "text")
    assert sorted(r.norm for r in norms.collect()) == ["an other line", "some line of some length, line of some length", "x"]
    sets = {r.node: set(r.all) for r in norms.select("node", line_dedup.windows(F.col("norm")).alias("all")).collect()}
    want = {}
    for node, hashes in sets.items():
        words = [0] * line_dedup.SKETCH_WORDS
        for h in hashes:
            words[(h & 0xFFFFFFFFFFFFFFFF) >> 6 & len(words) - 1] ^= 1 << (h & 63)
        want[node] = (len(hashes), *words)
    assert {r.node: (r.n, *(r[f"w{k}"] & 0xFFFFFFFFFFFFFFFF for k in range(line_dedup.SKETCH_WORDS))) for r in line_dedup.sketched(norms).collect()} == want
    rows = [(1, "abcdefghijklmnop", 7), (2, "abcdefghijklmnopq", 8), (3, "abcdefghijklmnopqrstuvwxyz", 17), (4, "qponmlkjihgfedcba", 8)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    assert [tuple(r) for r in line_dedup.verified(spark.createDataFrame(rows, "node long, norm string, n long"), pairs, 75).collect()] == [(1, 2)]


def test_groups_of_two_need_no_sketches(spark):
    # both groups leave members outside their pivot's class; only the one of three has a pair that wasn't held against the pivot
    groups_ = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (5, 6), (5, 7)], "pivot long, node long")
    asked = []

    def sketches(nodes):
        asked.extend(r.node for r in nodes.collect())
        return nodes.select("node", F.lit(50).alias("n"), F.lit(0).cast("long").alias("w0"))

    found = classes(groups_, sketches, lambda pairs: pairs.where("a = 6 and b = 7"), 75, 1, "test")
    assert sorted(asked) == [5, 6, 7]
    assert {r.node: r.component for r in found.collect()} == {6: 6, 7: 6}


def test_line_dedup_compares_sizes_before_texts(spark):
    text = spark.createDataFrame([(1, "", 6), (2, "", 8), (3, "", 9)], "node long, norm string, n long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted((r.a, r.b) for r in line_dedup.alike(pairs, text, 75).collect()) == [(1, 2), (2, 3)]


def test_whole_sets_of_candidates_only(spark, monkeypatch):
    """Documents that share half of their words have join keys in common, but their sketches part them before their whole sets are made."""
    word = lambda *k: " ".join(f"w{x}" for x in k)
    texts = [(k, word(*range(60), *range(1000 * k, 1000 * k + 60))) for k in range(1, 7)] + [(10, word(*range(9000, 9120))), (11, word(*range(9000, 9120), 7))]
    made, old = [], parity_join.whole_sets
    monkeypatch.setattr(parity_join, "whole_sets", lambda docs, ids: made.append(sorted(r.doc_id for r in ids.collect())) or old(docs, ids))
    found = {r.doc_id: r.component_id for r in parity_join.join(frame(spark, texts)).collect()}
    assert found == {**{k: k for k in range(1, 7)}, 10: 10, 11: 10}
    assert {i for ids in made for i in ids} == {10, 11}


def test_written_leaves_no_shuffle_files(spark):
    import time

    from voxelia.llm.common import CLEAN, written

    def files():
        return {f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")}

    before = files()
    out = written(spark.range(100000).groupBy((F.col("id") % 1000).alias("k")).count(), "test")
    end = time.time() + 10
    while (left := files() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(CLEAN) == "false"
