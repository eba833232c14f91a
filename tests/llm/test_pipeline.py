"""The pipeline on planted documents, stage by stage, and the queries on a small scale factor."""

import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from voxelia.llm import byte_bpe, quality

from .test_pairs import best_distance, groups, shingles

ROOT = Path(__file__).parents[2]
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, words):
    return " ".join("".join(r.choices("bcdfglmnprst", k=1) + r.choices("aeiou", k=1) + r.choices("bcdfglmnprst", k=1) + r.choices("aeiou", k=1)) for _ in range(words))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    clean = [(k, "\n".join(prose(r, 60) for _ in range(3))) for k in range(40)]
    item = prose(r, 30)
    planted = [(100, "too short"), (101, None), (102, ""), (103, "spam spam spam " * 60), (104, clean[0][1]), (105, clean[1][1].replace("a", "a", 1) + " " + prose(r, 3)),
               (106, prose(r, 80) + " " + item.upper() + " " + prose(r, 80)), (107, prose(r, 60) + "\n" + clean[2][1].split("\n")[1] + "\n" + prose(r, 60))]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in clean + planted], SCHEMA).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return out, dict(clean + planted)


def test_stages(spark, folder):
    path, texts = str(folder[0]), folder[1]
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, docs, path), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    good, lines, groups, leaks, ids = seen
    assert set(texts) - set(good) == {100, 101, 102, 103}
    assert set(good) - set(lines) == {104} or set(good) - set(lines) == {104, 105}  # all their lines repeat
    assert len(lines[107].text.split("\n")) == 2 and lines[0].text == texts[0] and lines[107].n_chars == len(lines[107].text)
    assert set(range(40)) <= set(groups) and 106 in groups
    assert set(groups) - set(leaks) == {106}
    enc = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert set(ids) == set(leaks)
    for i, r in ids.items():
        assert r.ids == enc.encode_ordinary(leaks[i].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(leaks[i].text.encode()).hexdigest()


def judged(text):
    """The quality rules, counted place by place."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)

    def marked(n, first):
        seen, out = {}, set()
        for k in range(len(words) - n + 1):
            g = tuple(words[k : k + n])
            if g in seen:
                out |= set(range(k, k + n)) | (set(range(seen[g], seen[g] + n)) if first else set())
            seen.setdefault(g, k)
        return out

    chars = max(sum(map(len, words)), 1)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    fine = len(words) >= 50 and 100 * len(marked(3, True)) <= 50 * len(words)
    fine &= all(sum(len(words[k]) for k in marked(n, False)) <= most * chars for n, most in quality.NGRAM_LIMITS.items())
    return fine and sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x)) <= quality.LINE_CHARS_LIMIT * chars


def undoubled(texts):
    """texts without the lines that an earlier one stands for; a text that loses all its lines goes."""
    norm = lambda x: x.strip(" \t\r\x0b\x0c").lower()
    lines = sorted((i, k, norm(x)) for i, t in texts.items() for k, x in enumerate(t.split("\n")) if norm(x))
    sets = [{x[k : k + 10] for k in range(max(1, len(x) - 9))} for _, _, x in lines]
    links = [(a, b) for b in range(len(lines)) for a in range(b) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    own = groups(range(len(lines)), links)
    gone = {lines[k][:2] for k, first in own.items() if k != first}
    out = {}
    for i, t in texts.items():
        parts = t.split("\n")
        stays = [x for k, x in enumerate(parts) if (i, k) not in gone]
        if len(stays) == len(parts) or any(norm(x) for x in stays):
            out[i] = "\n".join(stays)
    return out


def test_run_against_brute_force(spark, folder):
    """Every stage done by hand, on what the one before kept."""
    texts = {i: t for i, t in folder[1].items() if judged(t)}
    texts = undoubled(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    own = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    texts = {i: t for i, t in texts.items() if own[i] == i}
    fold = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    items = [fold(r.text) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect() if r.text]
    texts = {i: t for i, t in texts.items() if all(best_distance(x, fold(t)) > int(0.2 * len(x)) for x in items)}
    enc = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wanted = sorted((i, enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items())
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(folder[0])).collect())
    assert got == wanted and set(range(40)) <= set(texts)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


COUNTS = {"op1_line_dedup": "documents", "op2_quality_rules": "documents", "op3_parity_join": "documents", "op6_token_files": "documents", "op7_secret_scan": "documents", "op8_byte_bpe": "documents", "op9_lm_scores": "documents", "op10_html_text": "pages"}


@pytest.mark.parametrize("name", COUNTS)
def test_one_row_each(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{COUNTS[name]}.parquet").count()


def test_entry_imports_without_the_optional_files(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "voxelia", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "voxelia").mkdir()
    for p in (ROOT / "voxelia").iterdir():
        if p.name != "llm":
            (tmp_path / "voxelia" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_stages_leave_only_the_last_table(spark):
    import os

    import corpus_pipeline

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    names = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES]
    left = [f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before]
    assert [f for f in left if f in names] == names[-1:]
