"""The pipeline against a version that goes row by row in plain Python."""

import hashlib
import random
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from chronofold.llm import byte_bpe, pii, quality_rules
from chronofold.llm.queries import oracle_sql, queries
from tests.llm.test_text_ops import brute_components, water_fill

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HOME = Path(__file__).resolve().parents[2]


def uniform(*parts):
    return int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / (1 << 52)


def plain(rows, ratio):
    """rows: (doc_id, text, lang, source, n_chars) to the pipeline's result as a multiset."""
    kept = []
    for r in rows:
        t, w = r[1] or "", WORD.findall(r[1] or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(windows)
        cover = {k + j for k, g in enumerate(windows) if count[g] > 1 for j in range(5)}
        data = np.frombuffer(t.encode(), np.uint8)
        bucket, inside = quality_rules.grams(data, np.array([0, len(data)]), len(ratio))
        score = ratio[bucket][inside].sum() / 65536 / max(1, inside.sum())
        if not (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and score >= quality_rules.THRESHOLD:
            kept.append(r)
    low = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in kept], 5, 80)}
    kept = [r for r in kept if r[0] is None or low[r[0]] == r[0]]
    kept = [(r[0], pii.scrub_text(r[1], b"synthetic tables")[0], *r[2:]) for r in kept]
    sizes, groups = Counter(), defaultdict(list)
    for r in kept:
        sizes[r[3]] += len(WORD.findall(r[1]))
    target = water_fill(dict(sizes))
    for r in kept:
        n = len(WORD.findall(r[1]))
        groups[r[3], n.bit_length()].append((uniform("mix", r[0]), r[0], r))
    path, pattern = queries_vocabulary()
    enc = byte_bpe.encoding(path, pattern)
    out = Counter()
    for (source, cls), members in groups.items():
        rate = target[source] / sizes[source]
        f, start = rate - int(rate), uniform("mix/start", source, cls)
        for i, (_, _, r) in enumerate(sorted(members, key=lambda m: m[:2]), 1):
            copies = int(rate) + int(np.floor(f * i + start) - np.floor(f * (i - 1) + start))
            ids = enc.encode_ordinary(r[1])
            out[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += copies
    return +out


def queries_vocabulary():
    from chronofold.llm.queries import vocabulary

    pytest.importorskip("public_tokenizers")
    return vocabulary()


def test_pipeline_equals_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if i % 10 == 0:
            text += ["mail", f"me{i}@site.example.org", "or", "4539148803436467"]
        if i % 15 == 1:
            text = [f"%%{rng.randint(0, 9)}$$" for _ in text]
        rows.append((i, " ".join(text), "en", rng.choice(["a", "b", None]), 0))
    for i in range(120, 160):
        base = rows[i - 100]
        own = base[1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own) if i % 2 else base[1], "en", "c", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "same " * 50, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain(rows, quality_rules.fit(docs, labels))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()


def test_query_names():
    assert {f"op{i}" for i in range(1, 11)} == {q.split("_")[0] for q in queries()}
    assert set(oracle_sql()) <= set(queries())


def test_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(HOME, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e\nq = e.queries()\nassert 'asof_recorded' in q and not [k for k in q if k.startswith('op') and '_' in k and k[2].isdigit()], sorted(q)\nassert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
