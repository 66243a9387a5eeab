import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

from textlode.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "tab\there", "▁", "a▁ b", "▁▁x", " " * 70, "x" + " " * 33 + "y",
    "<s> </s> <unk> <0x41>", "日本語テキスト", "😀 é é", "\x00", "�", " ⁇ ", ");\r\n", "aaaaaaaaaaaaaaaaaaaaa", "l'été d'où", "1234567,89",
    "word " * 5000, "x" * 20_000, "ab" * 9_999 + "é" * 3_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(spark, library):
    rng = random.Random(3)
    pieces = [p.replace("▁", " ") for p, kind in piece_bpe.read_model(PATH)["pieces"] if kind == piece_bpe.NORMAL]
    alphabet = ["a", "e", "t", "th", " ", "  ", "\n", "\r", ";", ")", "▁", "1", "é", "日", "\t", "😀", "<s>", "\x00", ". ", ","]
    texts = list(ODD) * 2
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(2000)]
    rows = [(i, x, "old", [1.5]) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, x array<double>").repartition(3)
    out = piece_bpe.decode(piece_bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "x", "ids", "decoded"]
    summed = {r["doc_id"]: r for r in out.select("doc_id", "ids", "decoded", "x", *piece_bpe.digests()).collect()}
    assert len(summed) == len(rows)
    for i, text in enumerate(texts):
        want = library.encode(text or "")
        got = summed[i]
        assert got["ids"] == want, text
        assert got["decoded"] == library.decode(want), text
        assert (got["n_tokens"], got["x"]) == (len(want), [1.5])
        assert got["ids_sha256"] == sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got["decoded_sha256"] == sha256(library.decode(want).encode()).hexdigest()


def test_any_ids_decode_as_the_library_does(library):
    rng = random.Random(4)
    decode = piece_bpe.Decoder(piece_bpe.read_model(PATH))
    for _ in range(5000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999), 29_871, 2]) for _ in range(rng.randint(0, 8))]
        assert decode(ids) == library.decode(ids), ids


def test_search_equals_plain_merging():
    model = piece_bpe.read_model(PATH)
    encoder = piece_bpe.Encoder(model)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("etaoinsrhdl▁", k=rng.randint(1, 60)))
        want = b"".join(encoder.ids[p] for p in piece_bpe.merged(text, model["rank"]))
        assert b"".join(encoder.search(text)) == want


def test_small_tables_of_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 2)
    encoder = piece_bpe.Encoder(piece_bpe.read_model(PATH))
    text = "the cat and the dog, the cat and the bird. " * 20
    assert len(encoder(text)) // 4 == len(library.encode(text))


def test_texts_are_not_cut_where_a_piece_links_characters():
    assert piece_bpe.cut_of(["ab", "▁a"]) != piece_bpe.WHOLE
    assert piece_bpe.cut_of(["ab", "b▁c"]) == piece_bpe.WHOLE


def test_other_models_raise(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.read_model(str(tmp_path / "m"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert piece_bpe.decode(piece_bpe.encode(df, PATH), PATH).collect() == []
