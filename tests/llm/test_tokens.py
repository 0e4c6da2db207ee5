"""Token counts, packed ids and SentencePiece against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from loomwork.llm import packing, pieces, token_counts, vocab
from tests.llm.data import corpus, frame, messy


def by_row(df, *columns):
    return sorted(
        (tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def test_token_counts_are_those_of_the_library(spark):
    rows = corpus() + messy()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((doc_id, len(text.encode()), n, n > 1024))
    got = by_row(
        token_counts.count_tokens(frame(spark, rows, clash=True)),
        "doc_id", "n_bytes", "n_tokens", "over_limit",
    )
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert token_counts.count_tokens(frame(spark, rows).limit(0)).count() == 0


def test_shortcut_strings_encode_alone_as_one_token():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        counter = token_counts.Counter(f.read())
    assert " the" in counter.whole and len(counter.whole) > 30_000
    assert "<|endoftext|>" not in counter.whole


def test_pieces_of_a_text_join_to_the_text():
    text = " ".join(f"word{i}\n" for i in range(1000))
    parts = list(vocab.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert list(vocab.pieces("x" * 1000, 100)) == ["x" * 1000]
    assert list(vocab.pieces("", 100)) == [""]


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_pack_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    packed = packing.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (packing.unpack(packed, bits, 0, 1001) == ids).all()
    assert (packing.unpack(packed, bits, 137, 501) == ids[137:638]).all()
    assert packing.unpack(packed, bits, 3, 0).size == 0


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_packed_files_read_back_in_order(spark, tmp_path):
    rows = corpus() + messy()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = frame(spark, rows, clash=True)
    packing.write_packed(df, f"{tmp_path}/ids", part_bytes=40_000, block_ids=500)
    got = packing.read_digests(spark, f"{tmp_path}/ids").collect()
    assert len(got) == len(rows)
    digests = {}
    for doc_id, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        digests.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids)))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        digests[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert spark.read.parquet(f"{tmp_path}/ids").select("part").distinct().count() > 1


def test_packed_ids_of_wanted_documents(spark, tmp_path):
    rows = corpus() + messy()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packing.write_packed(frame(spark, rows), f"{tmp_path}/ids", part_bytes=40_000, block_ids=500)
    wanted = [7, 7, 23, 104, 105, 106, 109, None, 999_999]
    asked = spark.createDataFrame([(i, "theirs") for i in wanted], "doc_id long, ids string")
    got = packing.read_ids(spark, f"{tmp_path}/ids", asked).collect()
    want = [
        (doc_id, library.encode(text or "", add_special_tokens=False).ids + [1])
        for doc_id, text, *_ in rows if doc_id in wanted
    ]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, want))
    assert packing.read_ids(spark, f"{tmp_path}/ids", asked.limit(0)).count() == 0


def test_packed_files_of_an_empty_table(spark, tmp_path):
    empty = frame(spark, corpus()).limit(0)
    packing.write_packed(empty, f"{tmp_path}/none")
    assert packing.read_digests(spark, f"{tmp_path}/none").count() == 0
    assert packing.read_ids(spark, f"{tmp_path}/none", empty).count() == 0


def model_bytes(unigram: bool = False) -> bytes:
    with open(public_tokenizers.path(pieces.FILE), "rb") as f:
        content = f.read()
    if unigram:
        model = proto.ModelProto()
        model.ParseFromString(content)
        model.trainer_spec.model_type = 1
        content = model.SerializeToString()
    return content


@pytest.mark.parametrize("chunk,giant", [(pieces.CHUNK, pieces.GIANT), (60, 200)])
def test_sentencepiece_ids_and_round_trip(spark, chunk, giant):
    rows = corpus() + messy()
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    df = frame(spark, rows, clash=True)
    got = pieces.decode(pieces.encode(df, chunk=chunk, giant=giant)).collect()
    want = sorted((str(r[0]), library.encode(r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert any(r.n_chunks > 1 for r in got) and {r.key for r in got} == {"theirs"}


def test_sentencepiece_of_an_empty_table(spark):
    empty = frame(spark, corpus()).limit(0)
    assert pieces.decode(pieces.encode(empty)).count() == 0


def parts_of(model, text, size):
    t, at, found = model.normalized(text), 0, []
    while at < len(t):
        end = min(at + size, len(t))
        end = len(t) if len(t) - end < model.longest else end
        before, after = t[max(0, at - model.longest) : at], t[end : end + model.longest]
        found.append((before + t[at:end] + after, len(before), len(before) + end - at))
        at = end
    return found


@pytest.mark.parametrize("unigram", [False, True])
def test_scan_of_chunks_finds_the_best_path(unigram):
    model = pieces.Model(model_bytes(unigram))
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(unigram))
    texts = ["internationalization" * 9, "日本語テキスト" * 20, "a b  c\n\n" * 30, "==== ab" * 20]

    def weight(ids):
        low = model.unknown_weight
        text_of = library.id_to_piece
        return sum(model.score.get(text_of(i), low if library.is_unknown(i) else 0.0) for i in ids)

    for text in texts + [r[1] for r in corpus(documents=8)]:
        want = library.encode(text)
        parts = parts_of(model, text, 40)
        matrices = [model.matrix(t, lo, hi, i == 0) for i, (t, lo, hi) in enumerate(parts)]
        states = pieces.resolve(matrices)
        ids = [i for p, s in zip(parts, states, strict=True) for i in model.trace(*p, *s).tolist()]
        if unigram:  # other pieces may reach the same sum, and the library sums single floats
            assert weight(ids) >= weight(want) - 1e-3
            assert model.decode(np.array(ids)) == text
        else:
            assert ids == want
        # the product is associative
        if len(matrices) > 2:
            left = pieces.combine(pieces.combine(*matrices[:2]), matrices[2])
            right = pieces.combine(matrices[0], pieces.combine(*matrices[1:3]))
            assert left[:2] == right[:2] and np.array_equal(left[2], right[2])


def test_new_words_reach_the_library_in_two_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encoder = packing.Encoder(f.read())
    plain = ["Hello", "Zoë", "naïve", "don't", "it's", "a1b22", "x,y", "!!", "中文", "'s", "e\u0301t\u00e9", "³", "ﬁx", "x" * 50]
    words = [f"{w}{i}" for w in plain for i in ("", "q", ".", "'", "'s", "!?_", "-x", "$$$$$")]

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    want = encoder.library(words)
    encoder.tokenizer = Counted(encoder.tokenizer)
    for given in (words, [], ["one"], ["!!"]):
        ids, lengths = encoder.joined(given)
        library = encoder.library(given)
        assert ids.tolist() == library[0].tolist() and lengths.tolist() == library[1].tolist()
    encoder.cut |= dict.fromkeys([".", "'", "!?_"], True)  # the library's cutting is not counted
    encoder.tokenizer.texts = 0
    got = encoder.memo.encoded(words)
    assert encoder.tokenizer.texts == 2
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    # a mark inside a word, or a letter that lower case makes several pieces, sends them one by one
    for odd in (packing.MARK, f"a{packing.MARK}b", "İstanbul"):
        ids, lengths = encoder.joined([*words, odd])
        library = encoder.library([*words, odd])
        assert ids.tolist() == library[0].tolist() and lengths.tolist() == library[1].tolist()


def test_words_that_differ_in_case_are_encoded_once():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encoder = packing.Encoder(f.read())
    texts = ["Ärger ÄRGER ärger, ÄRGER, naïve NAÏVE ß µ ÿ Ÿ", "ODD odd Odd. odd.", "ΣΑΣ Σας İ", ""]
    ids, counts = encoder.encode(texts)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert {"odd", "odd."} <= set(encoder.memo.index) and "ODD" not in encoder.memo.index
    every = "".join(map(chr, range(256))).split()
    ids, _ = encoder.encode([" ".join(every)])
    assert ids[:-1].tolist() == encoder.tokenizer.encode(" ".join(every), add_special_tokens=False).ids
