import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convorecall.llm import packing, wavelet
from convorecall.llm.tokens import PieceEncoder

TEXTS = ["a b   c d\n\nf don't  it's 5 000 y　z", "", None, " lead", "trail ", "É é, Ça.Va,b . , \t tab\tq", "\x01 a\x01b", "<|endoftext|> x", "word " * 3000, "a\x00b"]


def test_packing(spark):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    want = {i: tool.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), 100).orderBy("doc_id", "piece").collect()
    for i, ids in want.items():
        own = [r for r in rows if r.doc_id == i]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [n for r in own for n in ids[r.start : r.start + r.length]] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        assert all(r.length == 100 for r in own[1:])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bin_completion():
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}
        made = packing.bin_completion(counts, 60)
        used = {}
        for filling, times in made:
            assert sum(filling) <= 60
            for s in filling:
                used[s] = used.get(s, 0) + times
        assert used == counts
    assert sum(t for _, t in packing.bin_completion({30: 10, 20: 3, 40: 3, 10: 6, 5: 12}, 60)) == 10


def fewest(pieces, capacity):
    """Least number of sequences, by trying every partition."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= pieces[i] and room not in rooms[:j]:
                place(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_fewest_sequences():
    rng = random.Random(5)
    for k in range(150):
        capacity = rng.choice([20, 30, 97])
        pieces = sorted((rng.randint(capacity // 6, capacity * 2 // 3) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = {s: pieces.count(s) for s in pieces}
        assert packing.lower_bound(counts, capacity) <= fewest(pieces, capacity) == sum(t for _, t in packing.bin_completion(counts, capacity)), pieces
    # the smallest pieces fill sequences of a thousand pieces and more
    made = packing.bin_completion({4: 1, 3: 1, 2: 3000}, 2048)
    assert sum(t for _, t in made) == 3 and sum(sum(f) * t for f, t in made) == 6007


def test_many_short_texts(spark):
    texts = ["a"] * 3000 + ["a b", "a b c"]
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 3002 and len({r.sequence_id for r in rows}) == 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3002


def test_repeated_documents_in_shards(spark):
    rows = [(7, "a b c " * 10)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("shard", F.lit(1))
    shards = wavelet.write_shards(df, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20)
    assert shards.count() == 4
    assert sorted(r.start for r in wavelet.read_shards(shards).collect()) == [0, 31, 62, 93]


def test_wavelet(spark):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tool.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS))[::-1], "doc_id long, text string")
    shards = wavelet.write_shards(df, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=50)
    at = 0
    for row, text in zip(wavelet.read_shards(shards).orderBy("doc_id").collect(), TEXTS, strict=True):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ids = np.random.default_rng(1).integers(0, 700, 3000).astype(np.uint16)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.ids() == ids).all()
    assert [m.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for token in (0, 5, 699):
        places = np.flatnonzero(ids == token).tolist()
        assert m.count(token) == len(places) and m.count(token, 100, 2000) == sum(100 <= p < 2000 for p in places)
        assert [m.locate(token, k) for k in range(len(places))] == places
    assert wavelet.read_shards(wavelet.write_shards(df.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_words_are_remembered_once_whatever_their_case_and_end():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = ["Straße straße, STRASSE. strasse", "H̱ ẖ ẖ İ Å,b 'S. 'Re, 'r,e don'T,x ÉTÉ été", "", "x" * 500 + ". Ünïcödé ﬁ ŉ ͅA", "a,b.c,D e\x01F. 1,2.3 a1.b", "<|StartOfText|> </w> </W>."]
    rng = random.Random(5)
    texts += ["".join(rng.choice("aAhHIſßéÉ̱̇̊.,' 1\x01日") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    tool = PieceEncoder(path, "word")
    flat, counts = tool.encode(data, offsets)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(ids) for ids in want]
    assert flat.tolist() == sum(want, [])
    tool = PieceEncoder(path, "word")
    line = np.frombuffer(b"Word word, WORD. word", np.uint8)
    tool.encode(line, np.array([0, len(line)]))
    assert len(tool.keys) == 3  # the word, a comma and a full stop
