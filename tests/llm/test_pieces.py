"""SentencePiece encoding: paths against all segmentations, exact round trips, odd rows."""

import itertools
import random

from loomspan.llm import pieces


def small_vocabulary():
    words = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "bab", "▁b", "▁▁", "é", "▁é"]
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *words]
    scores = [0.0] * 257 + [-7.1, -3.0, -3.3, -4.9, -5.2, -3.9, -6.0, -7.7, -8.5, -4.4, -6.5, -5.0, -8.0]
    return pieces.build(names, scores, [False] * 257 + [True] * len(words), list(range(1, 257)))


def brute(text, v):
    keys = {p: i for i, p in enumerate(v.pieces) if i > 256}
    best = float("-inf")
    chars = list(text)
    for cuts in itertools.product([0, 1], repeat=len(chars) - 1):
        parts, part = [], chars[0]
        for c, cut in zip(chars[1:], cuts):
            if cut:
                parts.append(part)
                part = c
            else:
                part += c
        parts.append(part)
        total = 0.0
        for p in parts:
            b = p.encode()
            total += v.scores[keys[b]] if b in keys else v.unknown if len(p) == 1 else float("-inf")
        best = max(best, total)
    return best


def test_best_path_against_all_segmentations():
    v, encoder = small_vocabulary(), pieces.Encoder(small_vocabulary())
    random.seed(5)
    for _ in range(300):
        text = "".join(random.choice("aab é") for _ in range(random.randint(1, 8)))
        ids = encoder.encode(text.encode()).tolist()
        score = sum(v.scores[i] for i in ids if i > 256)
        unknown = sum(v.pieces[i][0] < 0x80 or v.pieces[i][0] >= 0xC0 for i in ids if i <= 256)  # bytes that begin a character
        assert abs(score + unknown * v.unknown - brute(" " + text, v)) < 1e-6
        assert pieces.decode(ids, v) == text.encode()


def test_double_array_holds_exactly_its_keys():
    random.seed(6)
    keys = {bytes(random.choice(b"abc\xc3\xff\x00") for _ in range(random.randint(1, 5))): i for i in range(400)}
    base, check, value = pieces.double_array(keys)

    def find(key):
        node = 0
        for c in key:
            to = base[node] + c
            if check[to] != node:
                return -1
            node = to
        return value[node]
    for key, i in keys.items():
        assert find(key) == i
    for _ in range(500):
        key = bytes(random.choice(b"abcd\xc3\xff\x00") for _ in range(random.randint(1, 6)))
        assert find(key) == keys.get(key, -1)


def test_round_trip_and_odd_rows(spark):
    v = pieces.load()
    texts = [None, "", " ", "  two  blanks ", "a▁b", "日本語 😀 \x00\t\r\n", "x" * 20_000, "<s> <0x41> </s>", "a b", "a b", "� é"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in pieces.encode(docs, v).collect()}
    assert len(rows) == len(texts) and all(r.exact for r in rows.values())
    assert rows[0].token_ids is None and rows[0].n_tokens == 0 and rows[1].token_ids == []
    assert rows[8].token_ids == rows[9].token_ids
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encode(docs, v), v).collect()}
    assert back == dict(enumerate(texts))
    assert pieces.encode(docs.limit(0), v).count() == 0


def test_cache_forgets_but_results_stay(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    v = small_vocabulary()
    encoder, fresh = pieces.Encoder(v), pieces.Encoder(v)
    for text in ("ab a b aba bab é ab a", "bab bab aab abb a ab"):
        assert encoder.encode(text.encode()).tolist() == fresh.encode(text.encode()).tolist()
    assert len(encoder) <= 3
