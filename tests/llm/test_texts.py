"""Operators on single texts against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelia.llm import byte_bpe, elias_fano, html_blocks, licences, lm, quality, queries, repair, secrets
from voxelia.llm.common import shared_dir

from .test_pairs import EDGES, LONG, frame, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = EDGES + [(None, "no id here at all"), (9020, "a|b <c> # $ * % &"), (9021, "x y z " * 40), (9022, "퟿ é̀ İ ß ŉ token,next"), (9023, "line\nline\nline \n\nline"), (9024, "same row"), (9024, "same row")]


@pytest.fixture(scope="module")
def docs(spark):
    return sample(spark) + TEXTS


def test_quality(spark, docs):
    def naive(text):
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]

        def marked(n, first):
            seen, out = {}, set()
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in seen:
                    out |= set(range(k, k + n)) | (set(range(seen[g], seen[g] + n)) if first else set())
                seen.setdefault(g, k)
            return out

        chars = sum(map(len, w))
        dup = [x for k, x in enumerate(lines) if x in set(lines[:k])]
        repeat = len(marked(3, True))
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        fine = all(sum(len(w[k]) for k in marked(n, False)) <= most * max(chars, 1) for n, most in quality.NGRAM_LIMITS.items())
        fine &= sum(len(x) for d in dup for x in WORD.findall(d)) <= quality.LINE_CHARS_LIMIT * max(chars, 1)
        return len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(dup), repeat, failed, not failed and fine

    key = lambda r: repr(tuple(r))
    got = quality.rules(frame(spark, docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(key, got)) == sorted(map(key, [(i, *naive(t)) for i, t in docs]))
    kept = quality.rules(frame(spark, docs), pass_through=True)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.kept for r in got)


def test_licences(spark):
    filler = "the quick survey of rivers and lakes in spring"
    given = [(k, f"{filler}\n{t}\n{filler} again") for k, t in enumerate(x for own in licences.TEMPLATES.values() for x in own)]
    families = [f for f, own in licences.TEMPLATES.items() for _ in own]
    near = [(500 + k, t) for k, t in enumerate(licences.NEAR_MISSES)] + EDGES + [(None, "Released under the MIT License."), (600, "RELEASED UNDER THE MIT LICENSE."), (600, "RELEASED UNDER THE MIT LICENSE.")]
    model = licences.train(frame(spark, sample(spark)))
    got = [(r.doc_id, r.paragraph, r.family) for r in licences.scan(frame(spark, given + near), model).collect()]
    right = sum((k, 1, f) in got for k, f in enumerate(families))
    assert right >= 0.9 * len(families)
    assert got.count((600, 0, "MIT")) == 2 and (None, 0, "MIT") in got
    assert all(i is None or i < len(families) and p == 1 or i == 600 for i, p, _ in got)  # nothing else
    assert licences.scan(frame(spark, []), model).count() == 0


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_dir(spark, "files")
    repair.write_token_files(frame(spark, docs), folder, path, end_id=2, block_tokens=5000)
    tok = repair.tokenizer(path)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids_le)) for r in repair.read_token_files(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    folder = shared_dir(spark, "files")
    repair.write_token_files(frame(spark, []), folder, path, end_id=2)
    assert repair.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 600_000 + " \u3000" * 300_000, "a" * 1_000_000, "-" * 1_000_000, "中" * 300_000])
def test_byte_bpe_of_long_runs(spark, run):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    (got,) = byte_bpe.encode(spark.createDataFrame([(1, f"x{run}y 7")], "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    assert bytes(got.decoded).decode() == f"x{run}y 7"
    plain, whole = byte_bpe.encoder(path, public_tokenizers.PATTERN), byte_bpe.encoder(path, byte_bpe.WHOLE)
    if run.isspace():
        assert got.ids == plain.encode_ordinary("x") + whole.encode_ordinary(run[:-1]) + plain.encode_ordinary(run[-1] + "y 7")
        short = f"x{run[:20_000]}{run[-20_000:]}y 7"
        assert [i for p, one in byte_bpe.pieces(short, 100) for i in (whole if one else plain).encode_ordinary(p)] == plain.encode_ordinary(short)


def test_special_strings_as_the_plain_tokenizer_has_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|> y", "<|endoftext |>", "Don't<|endoftext|>'s é"]
    flat, sizes = repair.ChunkEncoder(path)(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("around", ["<div id=main><div>{}</div></div>", "<div>{}</div>", "<div class='x'><section>{}</section></div>"])
def test_html_of_an_article_in_plain_divs(around):
    body = "".join(f"<p>Paragraph {k} of the article, which says this and that at some length, where <math><mi>n</mi></math> is small.</p>" for k in range(4))
    page = "<html><head></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>" + around.format(body) + "<footer><p>Contact us</p></footer></body></html>"
    (text,) = html_blocks.main_texts(html_blocks.trained(), [page])
    assert text == "\n".join(f"Paragraph {k} of the article, which says this and that at some length, where n is small." for k in range(4))


def test_html_of_many_unclosed_elements():
    import time

    began = time.time()
    assert html_blocks.blocks("<p>" + "<b>" * 20_000 + "text</p>" + "</i>" * 20_000)[0][1] == "text"
    assert time.time() - began < 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.data())
def test_repair_round_trip(ids, data):
    ids = np.array(ids * 8, np.int32)
    rules, body = repair.compress(ids, 10, min_count=3)
    spans = repair.spans_of(rules, 10)
    assert np.array_equal(repair.expand(body, rules, 10, spans), ids)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    if a < b:
        assert np.array_equal(repair.slice_ids(body, rules, spans, 10, a, b), ids[a:b])


def test_secrets(spark, docs):
    planted = ["password = 'abcdEF12345'", "Api-key: x", "API_KEY:abcdefgh", "token=short", "AKIA" + "A1" * 10, "akia" + "A" * 20, "0123456789abcdef" * 3, "ab12" * 7, "secret: passwd=longenough1", "ghp_" + "a1" * 20, "é€😀 secret=zzzzzzzz token:yyyyyyyyy", "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefghij KEY"]
    given = docs + [(9400 + k, f"text 😀 {p} end {p}") for k, p in enumerate(planted)]

    def naive(text):
        found = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.regex, text or "", re.ASCII) if len(m[r.group]) >= r.least]
        show = lambda s: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(s))
        base = [s for s in found if s[1] < 3]
        return (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), show(found))

    got = secrets.digests(secrets.scan(frame(spark, given))).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *naive(t))) for i, t in given)
    assert secrets.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("regex", "texts"), [("abc[xy]?d", ["abcd", "abcxd"]), ("(foo|barbaz)+q", ["fooq", "foobarbazq"]), ("(?i)tOken[:=]+x", ["TOKEN:=x"])])
def test_trigram_queries_hold_for_matches(regex, texts):
    query = secrets.trigram_query(regex)
    for t in texts:
        assert any(all(g in t.lower() for g in way) for way in query)
    assert secrets.trigram_query("[0-9a-f]+") == secrets.EVERY


def test_byte_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import tiktoken

    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.digests(byte_bpe.encode(frame(spark, docs), path, public_tokenizers.PATTERN, longest=700)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in docs]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert byte_bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 10**12)), min_size=1, max_size=200, unique=True))
def test_elias_fano_level(tmp_path_factory, pairs):
    pairs = np.array(sorted(pairs), np.int64)
    path = str(tmp_path_factory.mktemp("ef") / "level.ef")
    elias_fano.write_shard(path, pairs[:, 0], pairs[:, 1], count=np.arange(len(pairs)))
    level = elias_fano.Level([(path, int(pairs[0, 0]), int(pairs[0, 1]), len(pairs))])
    asked = np.array(sorted({(a, b + d) for a, b in pairs.tolist() for d in (0, 1)}), np.int64)
    at, count = level.find(asked[:, 0], asked[:, 1], "count")
    place = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    assert at.tolist() == [place.get(tuple(a), -1) for a in asked.tolist()]
    assert all(c == a for a, c in zip(at, count, strict=True) if a >= 0)


def test_language_model(spark, docs):
    df = frame(spark, docs)
    model = lm.train(df.where(lm.in_training()), order=3)
    words = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = {}
    for i, t in docs:
        for w in [] if held(i) else words(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
    got = lm.score(df, model).collect()
    key = lambda i, h, k, kn, tr: repr((i, h, k, kn, tr))
    assert sorted(key(*r[:5]) for r in got) == sorted(key(i, held(i), len(words(t)), sum(w in counts for w in words(t)), n) for i, t in docs)
    scored = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in docs:
        assert scored[i, len(words(t))].base_score == pytest.approx(base(t), rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # context helps on texts it hasn't seen


def test_html_on_pages_it_has_not_seen(spark):
    r, pages, want = random.Random(991), [], []
    while len(pages) < 120:
        html, labels = html_blocks.made_page(r)
        found = html_blocks.blocks(html)
        if len(found) == len(labels):
            pages.append(html)
            want.append([b[1] for b, y in zip(found, labels, strict=True) if y])
    rows = [(k, f"u{k}", h, "x") for k, h in enumerate(pages)] + [(900, None, None, None), (901, "", "", ""), (902, "u", "<p>", "x"), (903, "u", pages[0], "x"), (903, "u", pages[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_blocks.extract(df).collect()]
    by_id = dict(got)
    hit = sum(len(set(by_id[k].split("\n")) & set(w)) for k, w in enumerate(want))
    assert hit >= 0.97 * sum(len(set(w)) for w in want)
    assert sum(len(set(by_id[k].split("\n")) - set(w) - {""}) for k, w in enumerate(want)) <= 0.03 * sum(map(len, want))
    assert by_id[900] == by_id[901] == by_id[902] == "" and got.count((903, by_id[0])) == 2
    assert html_blocks.extract(df.where("false")).count() == 0


def test_html_page_by_hand():
    page = "<html><head><title>no</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><article><h1>The  title &amp; more</h1><p>First paragraph\nof this article, long enough to be read by someone.<p>Second paragraph with &eacute; in it and a few more words here.</article><footer><p>Contact us</p></footer></body></html>"
    (text,) = html_blocks.main_texts(html_blocks.trained(), [page])
    assert text == "The title & more\nFirst paragraph of this article, long enough to be read by someone.\nSecond paragraph with é in it and a few more words here."


def test_long_text_is_long():
    assert len(LONG) > 100_000


def test_registered_language_model_holds_all_three_word_ngrams(spark, tmp_path):
    texts = {k: t for k, t in enumerate(["a b c d", "a b d", "b c a b c", "c d a b", "d d a c b", "a b c", "b c d e", "c a b d"], 1)}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    assert 0 < sum(map(held, texts)) < len(texts)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, train = [{}, {}, {}], [[*t.split(), "\n"] for i, t in texts.items() if not held(i)]
    for w in train:
        for k in range(3):
            for at in range(len(w)):
                own = (["\n", *w])[max(0, at + 1 - k) : at + 2]
                if len(own) == k + 1:
                    counts[k][tuple(own)] = counts[k].get(tuple(own), 0) + 1
    n, v = sum(counts[0].values()), len(counts[0])

    def p(gram):
        if len(gram) == 1:
            return (counts[0].get(gram, 0) + 0.5) / (n + 0.5 * (v + 1))
        h, own = gram[:-1], counts[len(gram) - 1]
        of = counts[len(gram) - 2].get(h, 0)
        after = [c for g, c in own.items() if g[:-1] == h]
        if not after:
            return p(gram[1:])
        return max(own.get(gram, 0) - 0.75, 0) / of + (1 - sum(c - 0.75 for c in after) / of) * p(gram[1:])

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    split = lm.score(docs, lm.train(docs.where(lm.in_training()), order=3, least=1, range_tokens=2))  # contexts of more than two n-grams in several shards
    for df in (queries.op9_lm_scores(spark, str(tmp_path)), split):
        got = {r.doc_id: r.score for r in df.collect()}
        for i, t in texts.items():
            w = ["\n", *t.split(), "\n"]
            assert got[i] == pytest.approx(sum(math.log10(p(tuple(w[max(0, at - 2) : at + 1]))) for at in range(1, len(w))), abs=0.01)
    none = docs.where("false")
    assert lm.score(none, lm.train(none)).count() == 0 and lm.score(docs, lm.train(none)).count() == len(texts)


BODY = "<article><h1>The title of it</h1><p>First paragraph of this article, long enough to be read by someone.<p>Second paragraph with a few more words in it here.</article>"


@pytest.mark.parametrize("start", ["<html><head><title>x</title><body>", "<html><head><title>x</title><meta charset=utf-8>", "<head><script>var a</script><link rel=x href=y>\n"])
def test_html_of_a_head_without_an_end(start):
    text, plain = html_blocks.main_texts(html_blocks.trained(), [start + BODY, "<html><head><title>x</title></head><body>" + BODY])
    assert text == plain and "First paragraph" in text


def test_html_paths_hold_every_open_element_and_class():
    deep = "<div class='a b c d e comments'>" + "<div class=item><ul><li>" * 12 + "a deep reply"
    ((path, text, _),) = html_blocks.blocks("<body>" + deep)
    assert text == "a deep reply" and {"body", "div.comments", "div.e", "div.item", "li"} <= set(path)
    page = "<html><head></head><body>" + BODY + "<div class='a b c d e comments'>" + "<div><ul><li>" * 8 + "Some reply by a reader of this page."
    assert html_blocks.main_texts(html_blocks.trained(), [page]) == html_blocks.main_texts(html_blocks.trained(), ["<html><head></head><body>" + BODY])


def test_repair_goes_on_until_no_pair_is_frequent():
    ids = np.tile(np.arange(64, dtype=np.int32), 3000)
    rules, body = repair.compress(ids, 100)
    assert len(body) < 3000 and np.array_equal(repair.expand(body, rules, 100, repair.spans_of(rules, 100)), ids)
    assert repair.spans_of(rules, 100).max() > 64
    pairs = np.unique(body[:-1].astype(np.int64) << 32 | body[1:], return_counts=True)[1]
    assert (pairs < 24).all()


def test_lm_words_of_a_column():
    """Tokens come from the Arrow column itself, with words as bytes.lower and bytes.split give them."""
    import pyarrow as pa

    from voxelia.llm import lm

    texts = ["  The\x0bthe\x1cend \n", "", None, " \t ", "\u00c9t\u00e9 \u00e9t\u00e9\u00a0x THE", "a", "long " * 50, "b"]
    want = [[*(t or "").encode().lower().split(), lm.END] for t in texts]
    number, hashes, sizes = lm.flat_numbers(pa.array(texts))
    assert sizes.tolist() == [len(w) for w in want]
    assert hashes[number].tolist() == [lm.xxhash.xxh3_64_intdigest(x) >> 1 for w in want for x in w] and len(set(number.tolist())) == len(hashes)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(lm.runs(batch, most=10))
    assert len(parts) > 2 and [i for ids, _ in parts for i in ids.to_pylist()] == list(range(len(texts))) and [t for _, own in parts for t in own.to_pylist()] == texts


def test_lm_ranks_stand_for_pairs():
    """Pairs are ordered alike through one number, through places and by two keys; lookups by rank leave out what has no value."""
    import numpy as np

    from voxelia.llm import lm

    r = np.random.default_rng(2)
    for top in (5, 1 << 20, 1 << 28, 1 << 40):
        first, second = r.integers(0, top, 400), r.integers(0, top, 400)
        first[200:], second[200:] = first[:200], second[:200]
        order, new = lm.ordered(first, second)
        assert sorted(order.tolist()) == list(range(400))
        got = list(zip(first[order].tolist(), second[order].tolist(), strict=True))
        assert got == sorted(got) and [got[i] for i in new.tolist()] == sorted(set(got))
    assert [x.tolist() for x in lm.ordered(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]

    class Found:
        def find(self, c, w):
            assert list(zip(c.tolist(), w.tolist(), strict=True)) == [(7, 0), (7, 4), (9, 4)]
            return (np.array([-1, 20, 31]),)

    contexts = lm.Ranks(np.array([1, 2, 0, -1, 1, 1]), np.array([-1, 7, 9]))
    words = lm.Ranks(np.array([1, 1, 1, 1, 1, 0]), np.array([0, 4]))
    made = lm.lookup(Found(), contexts, words)[0]
    assert made.of.tolist() == [1, 2, -1, -1, 1, 0] and made.entries().tolist() == [20, 31, -1, -1, 20, -1]
