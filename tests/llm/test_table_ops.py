import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import chat_format as chat, embedding_dedup, quality_classifier as qc


def brute_vectors(data, threshold):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(data)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = data[i], data[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                link[i, j] = link[j, i] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    low = [d[0] for d in data]
    for _ in range(n):
        low = [min([low[i], *(low[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    return Counter((d[0], int(link[i].sum()), low[i], d[0] == low[i]) for i, d in enumerate(data))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    data = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(15):
            v = (centre + rng.normal(size=16) * 0.12).astype(np.float32).astype(float)
            data.append((len(data), [float(x) for x in v], int(c % 3)))
    data += [(500 + i, data[3][1], 0) for i in range(30)]  # a group of copies
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [], [1e200] * 16, [2e200] * 16, [1e-300] * 16]
    data += [(700 + i, v, 0) for i, v in enumerate(bad)] + [(800, data[3][1], None), (801, [-0.0] + [1.0] * 15, 1), (802, [0.0] + [1.0] * 15, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "rep": F.lit(2), "v": F.lit(3), "cell": F.lit(4)})
    far = {707, 708, 709}  # their squares leave the range of doubles; they are looked at below
    keep = [d for d in data if d[0] not in far]
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(df.filter(~F.col("vec_id").isin(list(far))), tile=16).collect())
    assert got == brute_vectors(keep, 0.98)
    got = embedding_dedup.near_vectors(df, tile=16).collect()
    by_id = {r[0]: r for r in got}
    assert by_id[707][2] == by_id[708][2] == by_id[709][2] == 707 and by_id[704][1] == 0
    assert embedding_dedup.near_vectors(df.limit(0)).isEmpty()


def test_transcripts(spark):
    rng = random.Random(8)
    data, truth = [], []
    for conv in (1, 2, 3, None):
        roles = (["system"] if conv == 2 else []) + ["user", "assistant"] * (300 if conv == 1 else 4)
        for t, role in enumerate(roles):
            text = "\n".join(rng.choice(["Some text that is long enough to be an ordinary line of prose.", "short", "- item", ""]) for _ in range(rng.randint(1, 4)))
            text = (text + " end") if text.strip() else "plain words"
            data.append((conv, t, role, text))
            truth.append((conv, t, role, text))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "position": F.lit(2)})
    turns = chat.parse_transcripts(chat.transcripts(df), part_rows=64)
    whole = turns.groupBy("conv_id", "turn").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])).alias("text"), F.first("role").alias("role"))
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in whole.collect())
    assert got == Counter(truth)
    one = turns.filter("conv_id = 2 and turn = 0").first()
    assert one.rendered == f"<|system|>\n{one.text}\n"


def test_transcript_without_markers_and_nulls(spark):
    df = spark.createDataFrame([(1, 0, "User: how are you?"), (1, 1, None), (1, 2, "AI: fine"), (2, None, "hello"), (2, None, "hello")], "conv_id long, turn long, text string")
    got = chat.parse_transcripts(df).collect()
    assert [(r.role, r.text) for r in sorted(got, key=lambda r: (r.conv_id, r.turn))][:2] == [("user", "how are you?\n"), ("assistant", "fine")]
    assert sum(r.n_lines for r in got) == 5
    assert chat.parse_transcripts(df.limit(0)).isEmpty()


def test_viterbi_equals_all_paths():
    """The decoded path is the best of all paths, by score."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 4):
        e = np.log(rng.uniform(0.01, 1, (n, 6)))

        def score(path, e=e):
            return chat.START[path[0]] + e[0][path[0]] + sum(chat.TRANSITION[a, b] + e[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:])))

        best = max(itertools.product(range(6), repeat=n), key=score)
        assert np.isclose(score(tuple(chat.decode(e, None, None))), score(best))


def test_viterbi_by_parts_equals_whole():
    rng = np.random.default_rng(3)
    e = np.log(rng.uniform(0.01, 1, (40, 6)))
    whole = chat.decode(e, None, None)
    first, second = e[:17], e[17:]
    score = chat.START + first[0]
    for row in first[1:]:
        score = (score[:, None] + chat.TRANSITION).max(axis=0) + row
    both = score[:, None] + chat.chain(second)
    last = int(both.max(axis=0).argmax())
    mid = int(both[:, last].argmax())
    assert (np.r_[chat.decode(first, None, mid), chat.decode(second, mid, last)] == whole).all()


def test_co_training(spark):
    rng = random.Random(6)
    docs, labels, pages = [], [], []
    for i in range(400):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["river", "stone", "light", "garden"] if good else ["BUY!!", "$$$", "click###", "free%%%"]) for _ in range(40))
        docs.append((i, text, "en", "s1" if good else "s2", len(text)))
        if i < 120:
            labels.append((i, int(good), 0))
        if i % 2:
            pages.append((i, f"https://{'site' if good else 'spam'}.example.com/en/{i}", ""))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (5, docs[5][1], "en", docs[5][3], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("host", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    p = spark.createDataFrame([*pages, (9999, None, ""), (9998, "nonsense", "")], "page_id long, url string, html string")
    got = qc.score(d, lab, p).collect()
    assert len(got) == len(docs)
    truth = {i: s == "s1" for i, _, _, s, _ in docs[:400]}
    assert all(r.kept == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(0 <= r.score <= 1 for r in got)
    flat = qc.score(d, lab.limit(0), p).select("score").distinct().collect()
    assert [r[0] for r in flat] == [0.5]


def test_co_training_sees_all_documents(spark):
    """Hosts that no document among the 4,000 unlabelled ones with the smallest hashes has are learnt as well."""
    rng = random.Random(7)
    order = [r[0] for r in spark.range(200, 6200).orderBy(F.xxhash64(F.lit("draw"), "id"), "id").collect()]
    late = set(order[4000:])
    docs, labels, pages = [], [], []
    for i in range(6200):
        good = rng.random() < 0.5
        text = " ".join(rng.choice(["river", "stone", "light", "garden"] if good else ["BUY!!", "$$$", "click###", "free%%%"]) for _ in range(12))
        docs.append((i, text, "en", "s"))
        if i < 200:
            labels.append((i, int(good), 0))
        host = ("late" if i in late else "early") + ("good" if good else "spam")
        pages.append((i, f"https://{host}.example.com/en/{i}", ""))
    docs.append((None, docs[0][1], "en", "s"))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.doc_id: r for r in qc.score(d, lab, p).collect()}
    hosts = {i: u.split("/")[2] for i, u, _ in pages}
    by = {h: [got[i].meta_score for i in got if i is not None and hosts[i] == h] for h in set(hosts.values())}
    assert min(by["lategood.example.com"]) > max(by["latespam.example.com"]) + 0.2
    moved = {r.doc_id: r for r in qc.score(d, lab, p, broadcast_ids=0).collect()}
    assert moved.keys() == got.keys() and all(abs(moved[i].score - got[i].score) < 1e-6 for i in got)


def test_pages_name_documents(spark):
    p = spark.createDataFrame([("https://a.example.org/fr/12?page=2",), ("http://b.example.com/en/12.html",), ("x",), (None,)], "url string")
    assert [tuple(r) for r in qc.page_metadata(p).collect()] == [(12, "b.example.com", "com", ".html", "")]


def test_vectors_are_sent_to_two_tasks_at_most(spark):
    """However many tiles the cells of a group have, no round deals a vector out more than twice; all pairs of
    tiles of a cell and of neighbouring cells meet once."""
    tiles = {0: 3, 1: 7, 2: 1, 4: 2}
    around = [(c, own, n, tiles.get(c + 1, 0), tiles.get(c - 1, 0)) for c, n in tiles.items() for own in range(n)]
    rows = spark.createDataFrame([("l", 1, i, 1, [1.0], *r) for i, r in enumerate(around)], "label string, d int, rep long, copies long, v array<double>, cell long, own int, tiles int, above int, below int")
    met = Counter()
    for df in embedding_dedup._rounds(rows, 7):
        dealt = df.select("rep", "base", "step", "s", "t", "side").collect()
        assert max(Counter(r["rep"] for r in dealt).values(), default=0) <= 2
        met.update(tuple(r)[1:] for r in dealt)
    want = Counter()
    for c, n in tiles.items():
        want.update({(c, 0, s, t, side): 1 for s in range(n) for t in range(s, n) for side in ((0,) if s == t else (0, 1))})
        want.update({(c, 1, s, t, side): 1 for s in range(n) for t in range(tiles.get(c + 1, 0)) for side in (0, 1)})
    assert met == want


def test_blocks_of_a_tile(spark, monkeypatch):
    """Tiles of many blocks, links joined on the way, vectors in single precision."""
    for name, value in {"ROWS": 7, "COLUMNS": 11, "PAIRS": 5, "LINKS": 9}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(7)
    near = rng.normal(size=(60, 24)) * np.r_[np.full(12, 1.0), np.full(12, 0.05)]
    v = np.r_[near, near[:40] + rng.normal(size=(40, 24)) * 0.12, near[0] + rng.normal(size=(50, 24)) * 0.05].astype(np.float32).astype(float)
    got = Counter()
    a = embedding_dedup._Side(v, None)
    for i, j in embedding_dedup._near_pairs(a, a, 0.98, True):
        got.update(zip(i.tolist(), j.tolist(), strict=True))
    cosine = (v @ v.T) / np.sqrt(np.outer((v**2).sum(1), (v**2).sum(1)))
    assert len(got) > 1000 and got == Counter((i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cosine[i, j] >= 0.98)
    data = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    for tile in (None, 20):
        assert Counter(tuple(r) for r in embedding_dedup.near_vectors(df, tile=tile).collect()) == brute_vectors(data, 0.98)
