"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, extra columns and empty tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cellweave.llm import bpe, cws, hmm, langid, mixing, nndescent, shingles, simhash, sstable, urlfilter, warc
from cellweave.llm.components import components

DOC = "doc_id long, text string, lang string, source string, start long, rank string"
EN = "the cat and the dog were running over the hill with another friend of theirs that day "
DE = "der hund und die katze sind heute mit einem anderen freund über den berg gelaufen und "


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [
        (0, None, None, "a"), (1, "", "en", "a"), (2, " \t\n", "en", None), (3, "12 34 !!", "en", "b"), (4, EN * 3, "en", "a"),
        (5, DE * 3, "de", "b"), (6, EN * 2 + DE * 2, "en", "a"), (7, "x" * 3000, "en", "c"), (8, "a <|endoftext|> b  \n c", None, "c"),
    ]
    for i in range(9, 60):
        lang, base = ("en", EN) if i % 2 else ("de", DE)
        rows.append((i, base + " ".join(rnd.choices(words, k=rnd.randint(1, 80))), lang, "abc"[i % 3]))
    long_text = " ".join(rnd.choices(words, k=3000))
    rows += [(60, long_text, "en", "a"), (61, long_text, "en", "a"), (61, long_text, "en", "a"), (62, long_text + " end", "en", "b"), (None, "lone row", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in corpus()], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def path(name):
    pt = pytest.importorskip("public_tokenizers")
    return str(pt.path(name))


def test_sstable_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = sorted((tuple(r) for r in sstable.digest(docs, path("word_bpe_49k.json"), 2, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = [(r[0], s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(rows, starts, ids)]
    assert Counter(got) == Counter(want)
    assert sstable.digest(empty, path("word_bpe_49k.json"), 2, str(tmp_path / "e")).count() == 0
    small = sstable.digest(docs, path("word_bpe_49k.json"), 2, str(tmp_path / "r"), shard_bytes=2000)
    assert Counter(map(tuple, small.collect())) == Counter(want) and len(list((tmp_path / "r").glob("part-*"))) > 10


def test_encoders_refuse_other_tokenizers():
    with pytest.raises(ValueError):
        sstable.WordCoder(open(path("byte_bpe_50k.json"), encoding="utf-8").read())
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(path("word_bpe_49k.json"), encoding="utf-8").read())


def test_word_coder_merges_plain_words_itself():
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(file), sstable.WordCoder(open(file, encoding="utf-8").read(), memo=40)
    rnd = random.Random(3)
    bare = ["Thinwh", "ersh", "Ciónquer", "DOÑ", "Œuvre", "a", "ZZ", "straße"]
    plain = [b + m for b in bare for m in ("", ".", ",", "###", "$$$", "%%%", "!!", "&&&", "***", "?!", "..,", ";:")]
    hard = ["it's", "don't!!", "x'###", "a1###", "##a", "...", "a-b..", "e\u0301a##", "<unk>", "İx.", "ﬁ!!", "a\u0300", "##'s", "\x00.", "!" * 300]
    for _ in range(30):
        text = " ".join(rnd.choices(plain + hard, k=60))
        assert np.frombuffer(coder.encode(text.encode()), coder.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    whole = []
    coder.tokenizer = type("", (), {"encode_batch_fast": lambda self, words, **_: whole.extend(words) or [library.encode(w, add_special_tokens=False) for w in words]})()
    for word in plain:
        coder.encode(word.encode())
    assert not whole


def test_sstable_lookup():
    w = sstable.ShardWriter(2)
    keys = [None, -5, 0, 3, 3, 10**12, *range(10**12 + 1, 10**12 + 4000)]
    seen = Counter()
    for k in keys:
        w.add(sstable.id_key(k) + seen[k].to_bytes(4, "big"), np.arange(30 if k is None else k % 50, dtype="<u2").tobytes())
        seen[k] += 1
    s = sstable.Shard(w.image())
    assert s.n_blocks > 1 and s.docs == len(keys)
    assert len(s.get(3)) == 2 and len(s.get(None)) == 1 and len(s.get(10**12 + 3999)) == 1
    assert s.get(4) == [] and s.get(10**13) == []
    assert [k for k, _ in s] == keys


def test_language_mixture(docs, empty):
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(langid.identify(docs).collect()) == len(corpus())
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert rows[4]["lang_pred"] == "en" and rows[5]["lang_pred"] == "de"
    assert set(rows[6]["languages"]) == {"en", "de"} and 0.2 < rows[6]["score"] < 0.8
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows if i is not None)
    assert langid.identify(empty).count() == 0
    assert langid.accept(docs).where("doc_id < 4").count() == 0 and langid.accept(docs).columns == docs.columns


def test_language_is_und_without_letters(spark, monkeypatch):
    train = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    odd = ["\u00bd", "\u00b2 \u2460", "\u2167", "\u0660", "_", "7", "\U0001f600", ""]
    rows = train + [(100 + i, t, "en") for i, t in enumerate(odd)] + [(200, "\u65e5\u672c", None), (None, EN, "en")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[100 + i]["lang_pred"] == "und" and got[100 + i]["score"] == 0 for i in range(len(odd)))
    assert got[200]["lang_pred"] in ("en", "de") and got[None]["held_out"] is False and got[None]["lang_pred"] == "en"
    monkeypatch.setattr(langid, "MAX_LABELS", 1)
    with pytest.raises(ValueError):
        langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_mixture_equals_plain_em(spark):
    train = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    labels, prob = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    counts = {}
    for _, text, lang in train:
        for c, n in zip(*langid.ngrams(text)):
            counts[lang, c] = counts.get((lang, c), 0) + n
    total = {x: sum(n for (y, _), n in counts.items() if y == x) for x in labels}
    p = lambda x, c: (counts.get((x, c), 0) + langid.SMOOTHING) / (total[x] + langid.SMOOTHING * langid.BUCKETS)
    cells, n = langid.ngrams(EN * 2 + DE)
    assert np.allclose(prob[cells], [[p(x, c) for x in labels] for c in cells])
    share = {x: 0.5 for x in labels}
    for _ in range(2000):
        new = dict.fromkeys(labels, 0.0)
        for c, k in zip(cells, n):
            mixed = sum(share[x] * p(x, c) for x in labels)
            for x in labels:
                new[x] += k * share[x] * p(x, c) / mixed / n.sum()
        share = new
    chosen, found = langid.mixture(cells, n, prob, np.log(prob))
    assert {labels[i] for i in chosen} == {"de", "en"}
    assert all(abs(share[labels[i]] - x) < 2e-3 for i, x in zip(chosen, found))


def test_em_finds_proportions():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(200), 3).T
    counts = rng.multinomial(20000, p @ [0.7, 0.3, 0.0]).astype(float)
    chosen, share = langid.mixture(np.arange(200), counts, p, np.log(p))
    assert set(chosen) == {0, 1} and abs(share[chosen.index(0)] - 0.7) < 0.03


def brute_links(x, threshold):
    s = x @ x.T
    np.fill_diagonal(s, -1)
    m, lab = s >= threshold, np.arange(len(x))
    while True:
        new = np.where(m | np.eye(len(x), dtype=bool), lab, len(x)).min(1)
        if (new == lab).all():
            return m.sum(1), lab
        lab = new


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    near = np.repeat(base[:6], 25, 0) + rng.standard_normal((150, 16)) * 0.05
    x = np.concatenate([base, near, base[:3]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0, 2.0], 1), (905, [], 1), (906, [1e200] * 16, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in nndescent.near_duplicates(frame, 0.95).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, lab = brute_links(unit, 0.95)
    assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == lab[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, *_ in odd)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert nndescent.near_duplicates(none).count() == 0


def nn(spark, x, parts=3, ids=None, **how):
    rows = [(i, np.asarray(v, float).tolist()) for i, v in zip(ids or range(len(x)), x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    return sorted((tuple(r) for r in nndescent.near_duplicates(frame, 0.95, **how).collect()), key=str)


def test_nn_descent_loses_no_ties(spark):
    few = [[1, 0], [1, 0], [1, 0.001], [0, 1]]
    assert nn(spark, few, 4) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]
    assert nn(spark, [[3, 4]] * 400) == sorted([(i, 399, 0, i == 0) for i in range(400)], key=str)
    rng = np.random.default_rng(1)
    close = np.ones(16) + rng.standard_normal((400, 16)) * 1e-4  # all link, none are equal
    assert all(r[1:] == (399, 0, r[0] == 0) for r in nn(spark, close))


def test_nn_descent_keeps_null_and_repeated_ids(spark):
    got = nn(spark, [[1, 0], [1, 0], [1, 0.01], [0, 1], [0, 1]], ids=[None, 7, 7, None, None])
    assert Counter(got) == Counter([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 1, None, True), (None, 1, None, True)])


def two_groups(copies, spread, rest, dim=32):
    """Two groups with a cosine of about 0.96 between them, among scattered vectors."""
    rng = np.random.default_rng(6)
    a = np.eye(dim)[0]
    b = 0.962 * a + np.sqrt(1 - 0.962**2) * np.eye(dim)[1]
    return np.concatenate([c + rng.standard_normal((copies, dim)) * spread for c in (a, b)] + [rng.standard_normal((rest, dim))])


@pytest.mark.parametrize("spread, how", [(0.0, {"orders": 2}), (0.002, {"orders": 1, "k": 4, "k_large": 8})])
def test_nn_descent_leaves_groups_that_fill_lists(spark, spread, how):
    x = two_groups(300, spread, 1500)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # No audit: what the search cannot see stays unseen.
    got = {r["vec_id"]: r for r in nndescent.near_duplicates(frame, 0.95, target=0.0, **how).collect()}
    n, lab = brute_links(x / np.linalg.norm(x, axis=1, keepdims=True), 0.95)
    assert lab[300] == 0 and all(got[i]["n_links"] == n[i] and got[i]["component_id"] == lab[i] for i in range(600))


def test_nn_descent_is_whole_where_the_search_misses(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "MAX_EXTRA", 0)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2000, 32))
    hot = base[:1] + rng.standard_normal((400, 32)) * 0.02
    x = np.concatenate([base, base[1:200] + rng.standard_normal((199, 32)) * 0.2, hot])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # No descent: the links of the hot group are nearly all links, and pairs are missed.
    got = {r["vec_id"]: r for r in nndescent.near_duplicates(frame, 0.95, orders=1, rounds=0).collect()}
    n, lab = brute_links(x / np.linalg.norm(x, axis=1, keepdims=True), 0.95)
    assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == lab[i] for i in range(len(x)))


def test_cut_sends_large_values_in_small_batches(spark):
    import pyarrow as pa

    from cellweave.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    def most(length, small):
        got = common.cut(spark.range(0, 2000, 1, 1).selectExpr(f"repeat('x', {length}) t").mapInArrow(sizes, "rows long, bytes long"), "batches", small).collect()
        assert sum(r["rows"] for r in got) == 2000
        return max(r["rows"] for r in got), max(r["bytes"] for r in got)

    limits = [spark.conf.get(k, None) for k in common.SMALL]
    assert most(10, True)[0] <= 512 < most(10, False)[0]
    assert most(50_000, True)[1] < 8 << 20
    assert [spark.conf.get(k, None) for k in common.SMALL] == limits


def test_hmm_forward_backward_and_scores(docs, empty):
    rng = np.random.default_rng(2)
    model = hmm.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(5), 2).T)
    seqs = [rng.integers(0, 5, n).astype("<u2") for n in (1, 4, 6)]

    def paths(s):
        total = 0.0
        for code in range(2 ** len(s)):
            st = [code >> i & 1 for i in range(len(s))]
            p = model.start[st[0]] * model.emit[s[0], st[0]]
            for a, b, o in zip(st, st[1:], s[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        return math.log(total)

    which = next(hmm.grouped(seqs))
    symbols, active = hmm._by_step(seqs, which)
    loglik = hmm.forward(model, symbols, active, model.start[:, None], False)[0]
    assert np.allclose(loglik, [paths(seqs[i]) for i in which])
    first, moves, emits, total = hmm.expected(model, seqs)
    assert np.isclose(first.sum(), 3) and np.isclose(moves.sum(), 8) and np.isclose(emits.sum(), 11) and np.isclose(total, loglik.sum())
    assert hmm.expected(hmm.maximise(first, moves, emits, 1e-9), seqs)[3] >= total
    wide = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    many = [rng.integers(0, 9, n).astype("<u2") for n in (1, 7, 40, 41, 42, 300)]
    for segment in (1, 7, 41):  # the counts of whole documents, however they are cut
        assert all(np.allclose(a, b) for a, b in zip(hmm.expected(wide, many), hmm.expected(wide, many, segment)))

    rows = {r["doc_id"]: r for r in hmm.score(docs, states=2, passes=2, vocabulary=100, lookup=150, classes=8).collect()}
    train = [r for r in corpus() if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in (r[1] or "").encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for r in corpus():
        words = (r[1] or "").encode().lower().split()
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        got = rows[r[0]]
        assert got["n_tokens"] == len(words) + 1 and got["train_tokens"] == n and got["n_known"] == 1 + sum(c[w] > 0 for w in words)
        assert math.isclose(got["base_score"], base, rel_tol=1e-9) and got["score"] < 0
    assert hmm.score(empty, passes=1).count() == 0


def test_hmm_codes_and_rare_scaling():
    table, frequent, room = {b"a": 9, b"b": 3, b"held": 0}, {b"a": 0}, np.array([0.5, 0.25])
    codes = hmm.Codes(table, frequent, room, 1, 6)
    docs = [[b"a", b"b", b"odd", b"a", b"odd"], [], [b"held"]]
    flat, rare = [], []
    for words in docs:
        flat += [*map(codes.__getitem__, words), codes.end]
        rare.append(codes.taken())
    size, known, base, share, symbols, odd = (c.to_pylist() for c in codes.columns(flat, [len(d) + 1 for d in docs], rare))
    kind = {w: zlib.crc32(w[-3:]) % 2 for w in (b"b", b"odd", b"held")}
    end = math.log10(7)
    assert size == [6, 1, 2] and known == [4, 1, 1]
    assert base == pytest.approx([2 + math.log10(4) + end, end, end])
    assert share == pytest.approx([math.log10(4) - room[kind[b"b"]] - 2 * room[kind[b"odd"]], 0, -room[kind[b"held"]]])
    assert [np.frombuffer(x, "<u2").tolist() for x in symbols] == [[0, 2 + kind[b"b"], 2 + kind[b"odd"], 0, 2 + kind[b"odd"], 1], [1], [2 + kind[b"held"], 1]]
    assert odd == [[{"word": b"odd", "times": 2}], [], []]
    # Values are scaled every few steps only, and rare symbols do not underflow.
    rng = np.random.default_rng(4)
    emit = np.full((3, 2), 1e-30)
    emit[2] = 1 - 2e-30
    model = hmm.Hmm(np.array([0.5, 0.5]), rng.dirichlet(np.ones(2), 2), emit)
    loglik, alphas, scales = hmm.forward(model, np.zeros(100, np.int64), np.ones(100, np.int64), model.start[:, None], True)
    assert loglik == pytest.approx(100 * math.log(1e-30)) and alphas.shape == (100, 2) and sum(c is not None for c in scales) == 100 // hmm.SCALE_STEPS


def test_hmm_score_is_the_likelihood_of_the_text(spark, monkeypatch):
    texts = ["b a B c", "a a rare word b", "c b a x", "", None, "a b odd x y z"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    made, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: made.append(train(*a)) or made[0])
    how = {"states": 2, "passes": 2, "vocabulary": 3, "lookup": 5, "classes": 2}
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id short, text string"), **how).collect()}
    model = made[0][0]
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    frequent = sorted(c, key=lambda w: (-c[w], w))[:3]
    kind = lambda w: zlib.crc32(w[-3:]) % 2
    room = [sum(c[w] + 1 for w in c if w not in frequent and kind(w) == k) + 1 for k in range(2)]
    for i, t in rows:
        total = 0.0
        words = split(t)
        symbols = [frequent.index(w) if w in frequent else 4 + kind(w) for w in words] + [3]
        for code in range(2 ** len(symbols)):
            state = [code >> n & 1 for n in range(len(symbols))]
            p = model.start[state[0]] * model.emit[symbols[0], state[0]]
            for a, b, o in zip(state, state[1:], symbols[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        for w in words:
            total *= 1 if w in frequent else (c[w] + 1) / room[kind(w)]
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-9)


def brute_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("how", [{}, {"chunk": 4}, {"agree": 2}, {"chunk": 4, "broadcast_bytes": 0}])
def test_simhash_components(spark, docs, how):
    got = simhash.near_duplicates(docs, **how).collect()
    fps = [brute_fingerprint(r[1]) for r in corpus()]
    ids = [r[0] for r in corpus()]
    lab = list(range(len(ids)))
    for _ in ids:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    lab[i] = lab[j] = min(lab[i], lab[j])
    least = {k: min((ids[i] for i in range(len(ids)) if lab[i] == k and ids[i] is not None), default=None) for k in set(lab)}
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, f"{f:016x}", least[k]) for i, f, k in zip(ids, fps, lab))


def test_bk_tree_finds_what_a_scan_finds():
    rnd = random.Random(4)
    values = list({rnd.getrandbits(64) for _ in range(200)} | {(1 << i) | (1 << j) for i in range(12) for j in range(12)})
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:40]:
        assert {values[i] for i in tree.within(q, 4)} == {v for v in values if (v ^ q).bit_count() <= 4}
    kept = simhash.local_roots(values, 4)
    assert len(set(kept)) == len({min(j for j in range(len(values)) if kept[j] == k) for k in kept})


def test_keep_one(spark, docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (60, 61)").count() == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    unique = docs.where("doc_id <> 61 and doc_id is not null")
    assert simhash.keep_one(unique).where("doc_id in (0, 1, 2)").count() == 1
    clash = docs.withColumns({c: docs["start"] for c in ("_row", "_id", "first", "component", "_doc", "fp", "key", "node", "_salt")}).repartition(5)
    for keep in (simhash.keep_one, shingles.keep_one):
        rows = keep(clash)
        assert rows.columns == clash.columns and rows.where("_row <> 7 or node <> 7 or _salt <> 7").count() == 0
        plain = keep(docs).select("doc_id", "text", "lang")
        assert sorted(map(str, rows.select("doc_id", "text", "lang").collect())) == sorted(map(str, plain.collect()))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 7), (4, 4), (20, 3), (3, 20)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (20, 1), (5, 5), (7, 5), (9, 5)}
    assert components(links.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nq", "x"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nä"), (0, "u", "x"), (7, "u", "z" * 200_000), (7, "u", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.digest(pages, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = [
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        for i, _, h in rows
    ]
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.digest(pages.limit(0), str(tmp_path / "e")).count() == 0
    records = warc.read_archives(spark, str(tmp_path / "w"))
    named = {r[0] for r in records.where("record_type = 'response'").select("record_id").collect()}
    refers = [r[0] for r in records.where("record_type = 'revisit'").select("refers_to_record").collect()]
    assert len(refers) == 3 and set(refers) <= named and len({r[0] for r in records.select("record_id").collect()}) == 3 * len(rows)
    nulls = spark.createDataFrame([(None, "u", "q"), (None, "u", "q"), (3, "u", "q")], "page_id long, url string, html string")
    assert Counter((r[0], r[3], r[4]) for r in warc.digest(nulls, str(tmp_path / "n")).collect()) == Counter([(None, "response", None)] * 2 + [(3, "response", None)])
    assert records.where("record_type = 'request'").count() == len(rows) and records.where("not digest_ok").count() == 0
    one = warc.assemble(records).where("metadata.capture_id = 5").first()
    assert bytes(one["response"]["body"]) == "WARC/1.1\r\n\r\n\r\n\r\nä".encode() and one["request"] is not None
    import gzip

    plain = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*.gz")))
    members = b"".join(gzip.compress(part + b"\r\n\r\n") for part in plain.split(b"\r\n\r\nWARC/1.1\r\nWARC-Type")[:1])
    assert len(list(warc.parse_archive(plain))) == 3 * len(rows) and len(list(warc.parse_archive(members * 3))) == 3
    with pytest.raises(ValueError):
        list(warc.parse_archive(plain[:-9]))


def test_weighted_sampling(docs, empty):
    got = cws.edits(docs).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in rows]
    want = Counter((r[0], len(t), hashlib.sha256(cws.edit(t, n).encode()).hexdigest()) for r, t, n in zip(rows, texts, [*texts[1:], texts[0]]))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[60]["fingerprint"] == by[61]["fingerprint"] and by[60]["near_next"] == 1.0
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 256
    assert cws.edits(empty).count() == 0 and cws.edits(docs.where("doc_id = 4")).first()["near_next"] == 1.0


def test_collision_rate_is_generalised_jaccard():
    a, b = b"one one two three three three four", b"one two two three five six"
    x, y = cws.terms_of(a), cws.terms_of(b)
    keys = set(x) | set(y)
    truth = sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)
    s = cws.signatures([a, b], 20_000)
    assert abs(cws.likeness(s[0], s[1]) - truth) < 0.015


def test_near_equal_texts_without_spaces_are_alike():
    rnd = random.Random(2)
    text = "".join(chr(rnd.randint(0x4E00, 0x5E00)) for _ in range(400))
    for a, b in ((text, "\u4e00" + text), (text, text[:200] + "\u4e00" + text[200:]), ("x" * 3000, "x" * 3001)):
        x, y = cws.terms_of(a.encode()), cws.terms_of(b.encode())
        truth = sum(min(x[k], y[k]) for k in set(x) | set(y)) / sum(max(x[k], y[k]) for k in set(x) | set(y))
        s = cws.signatures([a.encode(), b.encode()], 20_000)
        assert truth > 0.9 and abs(cws.likeness(s[0], s[1]) - truth) < 0.015
        assert math.isclose(sum(x.values()), len(a.encode()))


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    text = open(path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, v = Tokenizer.from_str(text), bpe.Vocabulary(text)
    known = [b" the", b"the", b" and", b" hill", b"ing"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(dict(zip(known, v.merge_many(known))), v.kind))
    assert (lexicon.numbers([*known, b"thex", b"", b"\xff"]) >= 0).tolist() == [True] * 5 + [False] * 3
    rnd, alphabet = random.Random(1), " \n\t\x1c\x85\xa0 　aAbé'sdt1234.,!?<|>endoftext日本ñ́😀\0​"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a <|endoftext|> b", "x\n <|endoftext|>y", "  a", "a  ", "", "a" * 3000, EN * 50]
    for coder in (bpe.Coder(v, lexicon), bpe.Coder(v)):
        for t, ids in zip(texts, coder.encode_many(texts)):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want and coder.decode(want) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path("byte_bpe_50k.json"), 50).collect()}
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, path("byte_bpe_50k.json"), 50).collect()}
    assert all(ids[i] == library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in corpus())
    assert bpe.round_trip(empty, path("byte_bpe_50k.json")).count() == 0


def test_bpe_handles_new_pieces_together():
    from tokenizers import Tokenizer

    text = open(path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, v = Tokenizer.from_str(text), bpe.Vocabulary(text)
    rnd, calls, split = random.Random(2), [], v.split
    v.split = type("", (), {"findall": lambda self, t: calls.append(t) or split.findall(t)})()
    words = ["".join(rnd.choice("aeinstz'é1.") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    texts = [" ".join(rnd.choices(words, k=50)) for _ in range(40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in bpe.Coder(v).encode_many(texts)] == want
    assert len(calls) <= 1 + len({t.split(" ")[0] for t in texts})  # one for all, one for what begins a text


def test_bpe_remembers_decimal_ids():
    from tokenizers import Tokenizer

    text = open(path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, v = Tokenizer.from_str(text), bpe.Vocabulary(text)
    known = [b" the", b" an", b"n", b" "]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(dict(zip(known, v.merge_many(known))), v.kind))
    rnd, alphabet = random.Random(3), "  \n\t\x1c\x85\xa0aann'sé1,.日😀\0"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["", " ", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "the an", "n" * 70, " a\n a"]
    coder = bpe.Coder(v, lexicon, memo=40, decimal=True)
    for _ in range(2):  # with generations of the memo in between
        for at in range(0, len(texts), 25):
            for t, (count, listed, decoded) in zip(texts[at : at + 25], coder.round_trips(texts[at : at + 25])):
                want = library.encode(t, add_special_tokens=False).ids
                assert (count, listed, decoded.decode()) == (len(want), ",".join(map(str, want)).encode(), library.decode(want, skip_special_tokens=False))
    assert coder.faithful and list(coder.round_trips([])) == []
    v.token[library.token_to_id("n")] = b"\xff"  # decoded texts come from ids
    coder = bpe.Coder(v, lexicon, decimal=True)
    assert [d for *_, d in coder.round_trips(["n,", "the"])] == ["\ufffd,".encode(), b"the"]
    assert not coder.faithful


def test_bpe_merges_many_as_one():
    v = bpe.Vocabulary(open(path("byte_bpe_50k.json"), encoding="utf-8").read())
    rnd = random.Random(4)
    words = ["".join(rnd.choice(a) for _ in range(n)).encode() for a in ("a", "ab", " aeinrst", "é日😀x") for n in range(24)] + [b"the" * 21, b"x" * 64, b"x" * 65, b"in" * 300]
    ids, size = v.merge_flat(words)
    assert [i.tolist() for i in np.split(ids, np.cumsum(size)[:-1])] == [v.merge_one(w) for w in words]
    assert v.merge_many([]) == [] and v.merge_many([b""]) == [b""]


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules(spark):
    urls = [None, "", "x", "http://A.Example.COM/en/71?q#f", "https://example.com/en/8", "ftp://com/en/", "http://com/en", "http://xcom/en/", "http://example.net/de/81/9", "http://q.net/de/8", "http://a.org?x", "http://a.org/es/#", "a://b://c/en/", "http://e.com/en/", "http://e.com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    trie, joined = (sorted(map(tuple, f(pages, [urlfilter.Rule(*r) for r in RULES]).collect())) for f in (urlfilter.judge, urlfilter.judge_by_join))

    def brute(u):
        host, path = urlfilter.split_url(u)
        fits = [(len(h) + len(p), h + p, a) for a, h, p in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    assert trie == joined == [(i, *brute(u)) for i, u in enumerate(urls)]
    with pytest.raises(ValueError):
        urlfilter.judge(pages, [urlfilter.Rule(*r) for r in RULES], max_rules=2)


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert [tuple(r) for r in sorted(rows, key=key)] == [tuple(r) for r in sorted(again, key=key)] and len(rows) == len(corpus())
    size = {r[0]: len((r[1] or "").encode().split()) for r in corpus()}
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for target in {r["target"] for r in rows}:
        own = [r for r in rows if r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows)


def test_rates_solve_the_dual(docs):
    rows = mixing.mix(docs, piece_rows=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect())) or Counter(r["taken"] for r in rows)
    for target in {r["target"] for r in rows}:
        own = [r for r in rows if r["target"] == target]
        mean = sum(r["size"] for r in own) / len(own)
        rate = lambda x, size: min(3.0, math.exp(min(x * size / mean, 600.0))) if size else 1.0
        low, high = -700.0, 700.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, r["size"]) * r["size"] for r in own) < target else (low, mid)
        if target < 3 * sum(r["size"] for r in own) * (1 - 1e-9):
            assert all(math.isclose(r["rate"], rate(low, r["size"]), rel_tol=1e-6) for r in own)
        by = {}
        for r in own:
            by.setdefault(r["size"], []).append(r["copies"])
        assert all(max(c) - min(c) <= 1 for c in by.values())


def test_mixing_raises_where_it_cannot_solve(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_targets():
    assert mixing.targets_for([("b", 100), ("a", 100), (None, 100)], (5, 2, 1), 3) == [75.0, 187.5, 37.5]
    out = mixing.targets_for([("a", 10), ("b", 1000), ("c", 0)], (5, 2, 1), 3)
    assert out[0] == 30 and out[2] == 0 and math.isclose(sum(out), 1010)


def test_pipeline_stages_compose(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "source_mix", "bpe_tokens"]
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.language_id(spark, docs, sf), sf)
    assert kept.columns == docs.columns
    texts = [r[0] for r in kept.select("text").collect()]
    fps = {brute_fingerprint(t) for t in texts}
    assert len(fps) == len(texts) and all((a ^ b).bit_count() > 4 for a in fps for b in fps if a < b)


def test_pipeline_stages_keep_clashing_columns(spark, docs, empty):
    import corpus_pipeline

    names = ("score", "lang_pred", "mix", "held_out", "_row", "_0", "_id", "size", "copies", "rate", "target", "_copy", "component", "first", "fingerprint")
    odd = docs.withColumns({n: docs["start"] for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() > 0
        assert out.where(" or ".join(f"`{n}` is null or `{n}` <> 7" for n in names)).count() == 0
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.bpe_tokens(spark, odd, "").count() == len(corpus())


def test_pipeline_drops_near_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        own = rnd.choices(words, k=300)
        copy = list(own)
        for at in rnd.sample(range(5, 295), 6):  # about 30 of 296 shingles differ: similarity about 0.82
            copy[at] = "new" + copy[at]
        texts += [" ".join(own), " ".join(copy)]
    texts += [texts[0]] * 50

    def similar(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    near = [i for i in range(0, 120, 2) if similar(texts[i], texts[i + 1]) >= 0.8]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in enumerate(texts)], DOC)
    kept = {r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert len(near) > 40 and not kept & {i + 1 for i in near} and set(range(0, 120, 2)) <= kept and not kept & set(range(120, 170))


def shingle_nodes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(4)
    signed = shingles._signed(docs)
    nodes = shingles.cut(signed.select(*[signed["_row"].alias("node"), "n", "minima", "bands"]), "nodes")
    return nodes, shingles.text_bytes(docs, "_row")


def passage_texts(rnd, many, own, passage):
    """Texts with ``own`` words each around one ``passage``."""
    out = []
    for _ in range(many):
        words = [f"v{rnd.randrange(10**9)}" for _ in range(own)]
        out.append(" ".join(words[: own // 2] + passage + words[own // 2 :]))
    return out


def test_shared_passages_make_few_pairs(spark, monkeypatch):
    rnd, pairs = random.Random(3), []
    nodes, texts = shingle_nodes(spark, passage_texts(rnd, 400, 40, [f"p{i}" for i in range(60)]))
    likely = shingles._likely
    monkeypatch.setattr(shingles, "_likely", lambda found, *a: pairs.append(found.count()) or likely(found, *a))
    assert shingles.link(nodes, texts).count() == 0
    assert sum(pairs) < 400 * 3 * shingles.BANDS / 4 and pairs[-1] < 400  # all of them: 79,800 pairs


def test_copies_that_differ_too_much_make_few_pairs(spark, monkeypatch):
    rnd, pairs = random.Random(8), []
    base = [f"w{i}" for i in range(150)]
    texts = []
    for at in range(500):  # up to 3 changed words link with the base, more with few texts
        copy = list(base)
        for place in rnd.sample(range(150), at % 10):
            copy[place] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8]
    least, before = list(range(len(texts))), None
    while least != before:
        before = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    linked = {i for pair in links for i in pair}
    nodes, rows = shingle_nodes(spark, texts)
    likely = shingles._likely
    monkeypatch.setattr(shingles, "_likely", lambda found, *a: pairs.append(found.count()) or likely(found, *a))
    got = {r["node"]: r["component"] for r in shingles.link(nodes, rows).collect()}
    assert got == {i: least[i] for i in linked} and 100 < len(linked) < len(texts) - 200
    assert pairs[-1] < len(texts) / 4 and sum(pairs) < 5 * shingles.STARS * len(texts)


def test_differences_from_hubs_lose_no_similar_pair(spark):
    rnd = random.Random(4)
    base, texts = [f"w{i}" for i in range(120)], []
    for family in range(30):  # members share up to 7 changed words, and have up to 3 of their own
        kin = list(base)
        for place in rnd.sample(range(120), family % 8):
            kin[place] = f"f{family}-{place}"
        for _ in range(6):
            copy = list(kin)
            for place in rnd.sample(range(120), rnd.randrange(4)):
                copy[place] = f"e{rnd.randrange(10**6)}"
            del copy[: rnd.randrange(3)]
            texts.append(" ".join(copy))
    texts = [" ".join(base), *dict.fromkeys(texts)]
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8}
    hub = [0 if i % 4 or i == 0 else 4 for i in range(len(sets))]  # 4 has a quarter of the nodes
    nodes, rows = shingle_nodes(spark, texts)
    likely = shingles.cut(spark.createDataFrame([(i, h) for i, h in enumerate(hub) if i != h], "a long, b long"), "likely")
    met = shingles.cut(spark.createDataFrame([(i, 0) for i in range(1, 20)], "a long, b long"), "pairs")
    pairs, _ = shingles._left(nodes.selectExpr("node", "node as part"), rows, [likely], [met], 0.8)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    close = [i == h or (max(i, h), min(i, h)) in similar for i, h in enumerate(hub)]
    at_hubs = {(max(i, h), min(i, h)) for i, h in enumerate(hub) if i != h and close[i]} - {(i, 0) for i in range(1, 20)}
    needed = {(i, j) for i, j in similar if hub[i] != hub[j] or not (close[i] and close[j])} - {(i, 0) for i in range(1, 20)}
    assert needed | at_hubs <= got and len({(i, j) for i, j in needed if hub[i] == hub[j]}) > 50


@pytest.mark.parametrize("stars", [0, 3])
def test_links_equal_brute_force(spark, stars):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = passage_texts(rnd, 40, 40, passage) + [" ".join(passage), " ".join(passage[:58]), "", "a", "b", "a b c", "a b c d e f", "a b c d e f g"]
    for many, edits in ((25, 1), (25, 2), (25, 3), (25, 5), (12, 8)):  # similarities from 0.5 to 0.95
        base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        for _ in range(many):
            copy = base[: 100 - rnd.randrange(12)]
            for at in rnd.sample(range(len(copy)), edits):
                copy[at] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8]
    least = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    linked = {i for pair in links for i in pair}
    nodes, rows = shingle_nodes(spark, texts)
    got = {r["node"]: r["component"] for r in shingles.link(nodes, rows, stars=stars).collect()}
    assert got == {i: least[i] for i in linked} and 20 < len(linked) < len(texts) - 40


def test_within(spark, monkeypatch):
    from cellweave.llm import common

    rows = spark.range(0, 1000).selectExpr("id * 37 + if(id % 3 = 0, 8589934592L * 5, 0) as _row", "id")
    ids = rows.where("id % 7 in (0, 3)").select("_row")
    wanted = {r[0] for r in rows.where("id % 7 in (0, 3)").select("id").collect()}
    for most in (common.BROADCAST_WORDS, 0):
        monkeypatch.setattr(common, "BROADCAST_WORDS", most)
        got = common.within(rows, ids)
        assert got.columns == rows.columns and {r["id"] for r in got.collect()} == wanted and got.count() == len(wanted)
        assert common.within(rows, ids.limit(0)).count() == 0
    many = common.within(rows.unionByName(rows), ids)
    assert many.count() == 2 * len(wanted)


def test_tasks_drop_what_earlier_jobs_kept(docs, monkeypatch):
    import gc
    import weakref

    from pyspark.sql import functions as F

    from cellweave.llm import words

    tasks, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: tasks.append(f) or real(df, f, schema))
    words.count_words(docs)
    langid.predict(docs, ["de", "en"], np.full((langid.BUCKETS, 2), 0.5))
    shingles._signed(docs.withColumn("_row", F.col("doc_id")))
    simhash.fingerprints(docs, 4)
    text = open(path("byte_bpe_50k.json"), encoding="utf-8").read()
    for task in tasks:
        coder = bpe.coder_for(text, bpe.compile_lexicon({}, "<u2"))
        assert coder is bpe.coder_for(text, bpe.compile_lexicon({}, "<u2"))
        held = weakref.ref(coder)
        del coder
        list(task(iter([])))
        gc.collect()
        assert held() is None
    assert len(tasks) == 4


def test_token_stage_sends_small_batches(spark, docs):
    many = docs.crossJoin(spark.range(20)).drop("id").coalesce(1)

    def rows(df, small):
        found = bpe.round_trip(df, path("byte_bpe_50k.json"), 50, **small)
        return Counter(map(tuple, found.collect())), "MapInArrow" in found._jdf.queryExecution().toString()

    whole, lazy = rows(many, {})
    few, left = rows(many, {"small": True})
    assert few == whole and lazy and not left  # written in the small batches of ``cut``


def test_mixed_repeats_rows_without_shuffling_them(spark, docs):
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(whole).collect()}
    out = mixing.mixed(whole)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, out.collect())) == Counter({tuple(r): copies[r["doc_id"]] for r in whole.collect() if copies[r["doc_id"]]})


@pytest.mark.parametrize("most", [1, 3, 5])
def test_repeated(spark, monkeypatch, most):
    from cellweave.llm import common

    rows = spark.range(0, 700).selectExpr("id * 37 + if(id % 3 = 0, 8589934592L * 5, 0) as _row", "id")
    copies = rows.selectExpr("_row", f"cast(id % {most + 1} as int) as copies").where("_row % 11 <> 0")
    want = Counter({r["id"]: r["id"] % (most + 1) for r in rows.collect() if r["_row"] % 11 and r["id"] % (most + 1)})
    for limit in (common.BROADCAST_WORDS, 0):
        monkeypatch.setattr(common, "BROADCAST_WORDS", limit)
        got = common.repeated(rows, copies, most)
        assert got.columns == rows.columns and Counter(r["id"] for r in got.collect()) == want
        assert common.repeated(rows, copies.limit(0), most).count() == 0


def test_shingle_sets_and_minima():
    rnd = random.Random(4)
    for n in (0, 1, 4, 5, 6, 900):
        words = [f"W{rnd.randrange(200)}" for _ in range(n)]
        wanted = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
        assert len(shingles.shingle_set(" \t".join(words).encode())) == len(wanted)
    a, b = ([f"w{i}" for i in range(at, at + 1500)] for at in (0, 160))
    x, y = (shingles.shingle_set(" ".join(w).encode()) for w in (a, b))
    least = [shingles.minima(v) for v in (x, y)]
    assert abs(shingles.similarity(x, y) - 1336 / 1656) < 1e-9  # 0.807
    assert (least[0] == least[1]).mean() >= 0.8 * shingles.AGREE and set(shingles.bands(least[0])) & set(shingles.bands(least[1]))
    assert len({*map(tuple, (shingles.shingle_set(t) for t in (b"a b", b"b a", b"a b c", b"a")))}) == 4
