import hashlib
import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tablelab.llm import chat, decontaminate, jaccard, kernels, packing, suffix, tokens

DOCS = "doc_id long, text string, n int, sig string"


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng: random.Random, text: list[str], edits: int) -> list[str]:
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def odd_documents() -> list[tuple]:
    """Copies, near copies, a large family, nulls, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    base = prose(rng, 150)
    texts = [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(60)]
    texts += [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(60)] + ["one", "One", "one two", "", "  \n", None, "é É", "ONE\ttwo"]
    long = prose(rng, 20_000)
    texts += [" ".join(long), " ".join(edited(rng, long, 300)), "\x0b".join(long)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (7, "another text under the same id, quite alone"), (None, texts[0]), (None, "nobody knows this id here")]
    return [(i, t, 1, "s") for i, t in rows]


def as_words(text):
    return (text or "").encode().lower().split()


def test_words_and_shingles_match_plain_python():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aBZ \n\tcé\x0b", k=rng.randint(0, 30))) for _ in range(500)] + [None, "", "  ", "a" * 100_000 + " b"]
    hashes, _, rows = kernels.words(*kernels.byte_rows(pa.array(texts)))
    known = {}
    for text, a, b in zip(texts, rows[:-1], rows[1:]):
        assert len(as_words(text)) == b - a
        assert all(known.setdefault(w, h) == h for w, h in zip(as_words(text), hashes[a:b]))
    assert len(set(known.values())) == len(known)
    values, ends = kernels.distinct(*kernels.shingles(hashes, rows, 3))
    assert [len(brute.shingle_set(t, 3)) for t in texts] == np.diff(ends).tolist()


@pytest.mark.parametrize("share", [(90, 100), (80, 100)])
def test_linked_sets_share_a_signature(share):
    rng = np.random.default_rng(3)
    num, den = share
    for trial in range(400):
        n = int(rng.integers(2, 300))
        levels = rng.choice([0, 3, 5, 8, 10, 20], size=3000, p=[0.2, 0.1, 0.2, 0.2, 0.2, 0.1]).astype(np.uint64)
        pool = (levels << np.uint64(58)) | (rng.integers(0, 2**58, 3000, dtype=np.uint64))
        x = set(rng.choice(3000, n, replace=False).tolist())
        y = set(x)
        for _ in range(int(rng.integers(0, max(1, n * (den - num) // den) + 1))):
            if rng.random() < 0.5 and len(y) > 1:
                y.discard(next(iter(y)))
            else:
                y.add(int(rng.integers(3000)))
        if x == y or den * len(x & y) < num * len(x | y):
            continue
        found = []
        for own in (x, y):
            m = len(own)
            sigs = set()
            for band in range(m.bit_length(), (m * den // num).bit_length() + 1):
                groups = max(1, ((1 << (band - 1)) * num // den) * (den - num) // (2 * den))
                one, more = jaccard.signatures(np.sort(pool[sorted(own)]), m - -(-m * num // den), groups, band)
                sigs |= {(band, int(s)) for s in np.concatenate([one, more])}
            found.append(sigs)
        assert found[0] & found[1], (trial, n)


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 280))
    b = np.unique(np.concatenate([b, a[:200]]))
    maps = jaccard.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(set(a) ^ set(b))


@pytest.mark.parametrize("k, share", [(3, (90, 100)), (5, (80, 100))])
def test_components_match_all_pairs(spark, k, share):
    rows = odd_documents()
    found = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), k=k, share=share)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute.jaccard_components([r[:2] for r in rows], k, *share), key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_large_buckets_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 3)
    rows = odd_documents()
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).select("doc_id", "component_id").collect()}
    assert got == {(i, c) for i, _, c in brute.jaccard_components([r[:2] for r in rows], 5, 80, 100)}


def test_keep_one_keeps_first_rows_whole(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCS)
    kept = jaccard.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    wanted = set()
    for i, n, c in brute.jaccard_components([r[:2] for r in rows], 5, 80, 100):
        if n == 0 or (i is not None and i == c):
            wanted.add(i)
    got = [r.doc_id for r in kept.collect()]
    assert wanted <= set(got) and set(got) - wanted <= {None}
    assert len(got) == len(set(got)) or got.count(7) == 2


def test_token_counts(spark):
    rng = random.Random(1)
    count = tokens.counter(tokens.VOCABULARY)
    alphabet = list("ab1. ,  \n\t\xa0é'’s") + ["　", "  ", "\x1c", " ", "\x0b"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(20_000)]
    by_words = pc.invert(pc.match_substring_regex(pa.array(texts), tokens.JOINED)).to_pylist()
    assert all(count.count(t, w) == len(count.encoding.encode_ordinary(t)) for t, w in zip(texts, by_words))
    rows = [(i, t, 0, "") for i, t in enumerate([*texts[:300], None, "", "word " * 3000, texts[5]])]
    lengths = [len(count.encoding.encode_ordinary(t or "")) for _, t, *_ in rows]
    found = tokens.limit_table(tokens.length_histogram(tokens.token_lengths(spark.createDataFrame(rows, DOCS))))
    for r in found.collect():
        over = [n for n in lengths if n > r.n_tokens]
        assert (r.docs, r.docs_over, r.tokens_over) == (lengths.count(r.n_tokens), len(over), sum(over))
        assert r.docs_up_to == len(lengths) - len(over) and r.tokens_kept == sum(min(n, r.n_tokens) for n in lengths)
    assert tokens.tokens_kept(found, 9).first()[0] == sum(min(n, 9) for n in lengths)
    assert tokens.length_quantile(found, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert tokens.limit_table(tokens.length_histogram(tokens.token_lengths(spark.createDataFrame([], DOCS)))).count() == 0


def test_best_boundaries_against_all_choices():
    rng = random.Random(3)
    for _ in range(40):
        sizes = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in sizes]
        for buckets in (1, 2, 3):
            costs = []
            for chosen in itertools.combinations(sizes, min(buckets, len(sizes))):
                if chosen[-1] == sizes[-1]:
                    costs.append(sum(n * (min(b for b in chosen if b >= s) - s) for s, n in zip(sizes, counts)))
            found, cost = packing.best_boundaries(sizes, counts, buckets)
            assert cost == min(costs) and found[-1] == sizes[-1] and len(found) <= buckets
    assert packing.best_boundaries([], [], 4) == ([], 0)


def test_packing_fills_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 50))), 0, "") for i in range(200)] + [(None, None, 1, ""), (3, "a b", 0, ""), (3, "a b", 0, "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), buckets=4, budget=300, max_length=64).toPandas()
    full = got[got.n_tokens > 0]
    assert full.n_tokens.max() <= 64 and (full.n_tokens <= full.padded_to).all()
    sizes = full.groupby(["bucket", "batch"]).agg(rows=("slot", "size"), slots=("slot", "nunique"), padded=("padded_to", "first"))
    assert (sizes.rows == sizes.slots).all() and (sizes.rows * sizes.padded <= 300).all()
    for _, own in sizes.groupby(level=0):
        assert (own.rows[:-1] == 300 // own.padded.iloc[0]).all()  # all but the last batch are full
    _, padding = packing.best_boundaries(*zip(*full.n_tokens.value_counts().items()), 4)
    assert (full.padded_to - full.n_tokens).sum() == padding
    count = tokens.counter(tokens.VOCABULARY).encoding
    assert got.n_tokens.sum() == sum(len(count.encode_ordinary(t or "")) for _, t, *_ in rows)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, piece string, at int"


def test_chats_read_back(spark):
    odd = [r"\### Assistant: </turn> ok", "</turn>", "a</tur", "n>&lt;&amp;#", "x</turn>\n### user: hi: there</turn>\n", "", None, "é\n### assistant: "]
    rows = [(c, t, r, x, "p", 1) for c, (r, x) in enumerate(itertools.product(["user", "assistant", "a: b", None, "#&# "], odd)) for t in (1, 0)]
    rows += [(None, None, "assistant", "z", "", 0), (-1, 2, "assistant", "y" * 50_000, "", 0), (-1, 2, "assistant", "y" * 50_000, "", 0)]
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    source = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        source.setdefault(c, []).append((r or "", x or ""))
    digests = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    for r in chats:
        turns = source[r.conv_id]
        learnt = [x for role, x in turns if role == "assistant"]
        shown = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        entities = str.maketrans(dict(chat.ENTITIES))
        assert shown == [x.translate(entities) if s.escaped else x for s, x in zip(r.loss_spans, learnt)]
        assert [s.escaped for s in r.loss_spans] == [chat.END in (x or "") for x in learnt]
        d = digests[r.conv_id]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256("".join(learnt).encode()).hexdigest() and d.loss_chars == len("".join(learnt))
        assert d.n_turns == r.n_turns == len(turns) and d.formatted_chars == len(r.formatted)
    moved = chat.format_chats(spark.createDataFrame(rows, TURNS)).withColumn("loss_spans", F.slice("loss_spans", 2, 9))
    assert any(r.loss_sha256 != digests[r.conv_id].loss_sha256 for r in chat.chat_digests(moved).collect())  # the digest is the mask's
    assert len(chats) == len(source) and chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_repeats_match_plain_python(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choices("abcé ", k=rng.randint(10, 120))) for _ in range(25)]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(60)] + ["a" * 500, "ab" * 300, None, "", "short", "é" * 45]
    texts += ["".join(rng.choices("abcd", k=3000)) * 2]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + [(5, texts[5], 0, ""), (5, "other", 0, ""), (None, texts[3], 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    for size, first in ((40, 10), (60, 20)):
        got = []
        for r in suffix.remove_repeats(docs, size=size, first=first).collect():
            got.append((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()))
        assert sorted(got, key=str) == brute.without_repeats([r[:2] for r in rows], size)
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_shared_passages_match_plain_python(spark, monkeypatch):
    rng = random.Random(11)
    parts = [" ".join(rng.choices(["a", "b", "é", "Word", "word"], k=rng.randint(2, 25))) for _ in range(40)]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 4)) + prose(rng, rng.randint(0, 60), 10**6)) for _ in range(60)]
    texts += ["and " * 30, "the " * 30, "THE\t" * 12 + "x", (" ".join(prose(rng, 12, 10**6)) + "\n") * 3, None, "", "one", " \n", "\x0b".join(texts[0].split())]
    texts += [" ".join(prose(rng, 3000, 10**6) + texts[3].split() + prose(rng, 300, 10**6))]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)]
    rows += [(900, "only " * 40, 0, ""), (901, " ".join(prose(rng, 30, 10**6)), 0, "")]
    rows += [rows[-1], (5, "other", 0, ""), (None, texts[3], 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    for words in (4, 10, 21):
        if words == 21:
            monkeypatch.setattr(suffix, "CHUNK", 100)
        want = brute.sharing([r[:2] for r in rows], words)
        assert len(set(want)) == 2
        got = suffix.remove_repeats(docs, words=words).select("doc_id", "n_bytes", "shares_passage").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], len((r[1] or "").encode()), w) for r, w in zip(rows, want)), key=str)
    assert suffix.remove_repeats(docs.limit(0), words=51).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs, words=3)


def test_long_documents_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 100)
    rng = random.Random(4)
    text = np.frombuffer("".join(rng.choices("ab", k=1000)).encode(), np.uint8)
    rows = suffix.sampled(text, suffix._asked(np.array([0, 1000]), None, 40), 20, 40)
    assert rows[:, 1].min() == 0 and rows[:, 2].max() == 960
    assert (np.sort(rows[:, 1])[1:] == np.sort(rows[:, 2])[:-1] + 1).all()


def least_distance(item: list[str], text: list[str]) -> int:
    best = [0] * (len(text) + 1)
    for word in item:
        now = [best[0] + 1]
        for j, other in enumerate(text):
            now.append(min(best[j] + (word != other), best[j + 1] + 1, now[-1] + 1))
        best = now
    return min(best)


def test_contaminated_documents_are_found(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(5, 60)) for _ in range(30)]
    docs = []
    for i, item in enumerate(items * 3):
        limit = int(len(item) * 0.2 + 1e-9)
        text = edited(rng, item, rng.choice([0, limit, limit, limit + 3]))
        if rng.random() < 0.4 and len(text) > 12:
            del text[rng.randrange(len(text))]
        docs.append((i, " ".join([*prose(rng, 40), *text, *prose(rng, 20)]).upper(), 0, ""))
    docs += [(900, None, 0, ""), (901, "", 0, ""), (902, " ".join(prose(rng, 8000)), 0, ""), (0, docs[0][1], 0, "")]
    table = [(i, " ".join(x) + "!") for i, x in enumerate(items)] + [(77, None), (78, "too short"), (79, " ".join(items[0]))]
    bench = spark.createDataFrame(table, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in table:
            words = [w.strip("!") for w in (item or "").split()]
            if len(words) >= 5 and (cost := least_distance(words, (text or "").lower().split())) <= int(len(words) * 0.2 + 1e-9):
                want[d, i] = cost
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert sum(got[x] == want[x] for x in got) >= 0.95 * len(got)
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.dtypes == frame.dtypes
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_walks_reach_their_recall():
    rng = random.Random(11)
    reps = decontaminate.repetitions()
    for n in range(5, decontaminate.CHUNK + 1):
        slack, trials = int(n * 0.2 + 1e-9), 200
        words, near = [], []
        for _ in range(trials):
            item = [rng.getrandbits(62) for _ in range(n)]
            other = list(item)
            for _ in range(slack):
                p = rng.randrange(len(other))
                rng.choice([lambda: other.__setitem__(p, rng.getrandbits(62)), lambda: other.pop(p), lambda: other.insert(p, rng.getrandbits(62))])()
            around = [[rng.getrandbits(62) for _ in range(k)] for k in (slack, 2 * n)]
            words.append(item)
            near.append((around[0] + other + around[1])[: n + 2 * slack])
        sizes = np.full(trials, n)
        at = np.arange(trials) * n
        keys = decontaminate.walk_keys(np.array(sum(words, []), np.uint64), at, at + n, sizes, reps)
        flat, same = np.array(sum(near, []), np.uint64), []
        for shift in range(2 * slack + 1):
            at = np.arange(trials) * (n + 2 * slack) + shift
            same.append(decontaminate.walk_keys(flat, at, at + n, sizes, reps) == keys)
        same = np.array(same)
        assert same.any(axis=(0, 1)).mean() >= decontaminate.RECALL
        assert same.mean(axis=1).max(axis=0).mean() ** (1 / decontaminate.SAMPLED) > decontaminate.AGREE  # at the best place
        unrelated = decontaminate.walk_keys(flat, np.roll(at, 1), np.roll(at, 1) + n, sizes, reps) == keys
        assert unrelated.any(axis=0).mean() < 0.01


def test_unrelated_windows_do_not_pass():
    rng = random.Random(12)
    zipf = np.cumsum(1 / np.arange(1, 20_001)).tolist()  # every tenth word is the most frequent one
    for weights in (None, zipf):
        for n in (5, 9, 15, 38, 59, 200, 1000):
            size = 400 if weights is None else 20_000
            texts = [" ".join(f"w{x}" for x in rng.choices(range(size), cum_weights=weights, k=k)) for k in [n] * 200 + [20_000]]
            block = decontaminate.Items(list(range(200)), texts[:200], 0.8, decontaminate.RECALL)
            hashes, _, rows = decontaminate._words(pa.array(texts[200:]))
            chunk, start = [rng.randrange(len(block.owner)) for _ in range(3000)], [rng.randrange(19_000) for _ in range(3000)]
            passed = len(block.candidates(np.stack([np.zeros(3000, np.int64), chunk, start], axis=1), hashes, rows))
            assert passed < (0.01 if n >= 15 else 0.1) * 3000  # each tried at all its shifts


def test_short_unspaced_and_long_items(spark):
    rng = random.Random(13)
    long = prose(rng, 3000, 5000)
    near = edited(rng, long, 250)
    del near[100:300:4]
    chinese = "机器学习模型需要大量的训练数据才能得到好的结果"
    docs = [
        (1, "so the answer is forty two indeed"), (2, "forty and two"), (3, "前面的话。" + chinese.replace("大量", "许多") + "，后面的话"),
        (4, "今天天气很好我们去公园散步吧大家都很高兴"), (5, " ".join([*prose(rng, 50), *near, *prose(rng, 50)])), (6, "a b\u3000c " + "x" * 50_000),
        (7, " ".join(long[:1200])), (8, "w " * 30_000),
    ]
    items = [(1, "Forty two"), (2, chinese), (3, " ".join(long)), (4, "..."), (5, "c"), (6, "w " * 12), (7, "two"), (8, "w " * 45)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (1, 7), (2, 7), (3, 2), (5, 3), (6, 5), (8, 6), (8, 8)}
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[1, 1].asDict() | {"similarity": 1.0} == dict(doc_id=1, item_id=1, distance=0, similarity=1.0, from_word=4, to_word=6)
    assert by[3, 2].distance == least_distance(list(chinese), list(docs[2][1].replace("。", "").replace("，", ""))) == 2
    assert by[5, 3].distance <= 600 and by[8, 6].distance == by[8, 8].distance == 0
    # Items below five words are reported, but no document goes for their sake.
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()} == {1, 2, 4, 6, 7}
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, bench, drop_words=1).collect()} == {4, 7}


def test_columns_with_any_name(spark):
    docs = spark.createDataFrame([(1, "call +1 (988) 555-2485 now", 2, 3)], "doc_id long, text string, `a.b` int, row int")
    assert jaccard.keep_one(docs).collect() == docs.collect()
    assert docs.withColumn("c1", F.lit(1)).transform(jaccard.keep_one).columns == [*docs.columns, "c1"]
