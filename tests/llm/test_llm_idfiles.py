"""Files of token ids against the library's own encoding."""

import json
import random
import re
import unicodedata
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
from pyarrow import fs
from pyspark.sql import functions as F
from skysift.llm import idfiles, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def content():
    with open(PATH) as file:
        return file.read()


def test_parts_go_to_the_model_as_bytes(content):
    """Every byte of UTF-8 stands for the character that the library gives it."""
    words, library = idfiles.Words(content), Tokenizer.from_str(content)
    some = [chr(c) for c in [*range(0xA1, 0x250), *range(0x400, 0x482), *range(0x3041, 0x3094), *range(0x4E00, 0x9FA5, 97)]]
    for part in ["größe", "дом", "日本語", "«»", *some]:
        level = library.pre_tokenizer.pre_tokenize_str(part)
        assert [idfiles._byte_level(part)] == [p for p, _ in level]
        assert words._part(part) == np.array([t.id for p, _ in level for t in library.model.tokenize(p)], "<u4").tobytes()


def plain(rows, end=2):
    """(doc_id, ids) of (doc_id, text) by whole texts."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("top", [0, 1, 5, 700, 10**6, 2**40, 2**64 - 1])
def test_elias_fano_round_trip(top):
    draw = random.Random(top)
    for n in (0, 1, 2, 8, 513, 9000):
        values = sorted(draw.randint(0, top) for _ in range(n))
        code, after = idfiles.EliasFano.load(b"xyz" + (data := idfiles.EliasFano.of(np.array(values, np.uint64)).dump()), 3)
        assert after == 3 + len(data)
        assert code.slice(0, n).tolist() == values
        for _ in range(20 if n else 0):
            a = draw.randrange(n)
            b = draw.randint(a, n)
            assert code.get(a) == values[a] and code.slice(a, b).tolist() == values[a:b]


def test_boundaries_take_few_bits():
    sizes = np.random.default_rng(1).integers(1, 2000, 100_000)
    assert len(idfiles.EliasFano.of(np.cumsum(sizes).astype(np.uint64)).dump()) * 8 / 100_000 < 13


def hard_texts():
    draw = random.Random(5)
    signs = ["a", "B", "é", "é", "́", "Σ", "ß", "İ", "日本", "😀", "'s", "’s", " ", "\u0085", " ", "\x1c", "\x00", "9", "٣", " ", "\n", "\t", "\r", "\x0b", "<|endoftext|>", "</w>", "-", "x" * 70]
    return [(1000 + i, "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))) for i in range(300)]


def test_words_encode_as_whole_texts(spark, content, monkeypatch):
    rows = [*brute.odd_rows(), *hard_texts()]
    got = idfiles.encode(brute.documents(spark, rows), content, end=2).collect()
    assert sorted(map(tuple, got), key=brute.key) == sorted(plain(rows), key=brute.key)
    monkeypatch.setattr(idfiles, "REMEMBERED", 3)
    monkeypatch.setattr(idfiles, "PARTS", 2)
    words = idfiles.Words(content)
    for (_, text), (_, ids) in zip(rows, plain(rows)):
        assert np.frombuffer(words.text_ids(text), "<u4").tolist() == ids[:-1]
    assert len(words.known) <= 3 and len(words.known.old) <= 3
    assert idfiles._splitter(content) and idfiles._splitter(content.replace('"Lowercase"', '"NFD"')) is None


def test_settled_texts_are_split_by_re_as_by_regex(content):
    pattern = json.loads(content)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    found = idfiles._splitter(content)
    assert isinstance(found.__self__, re.Pattern)
    settled = [c for c in map(chr, range(0x10000)) if idfiles.SETTLED.fullmatch(c)]
    draw = random.Random(3)
    texts = ["".join(settled), " ".join(settled), "a\u0130b it's I'LL 1\u00b2\u00bd", ""]
    texts += ["".join(draw.choice(settled if k % 2 else settled[:200]) for _ in range(50)) for k in range(2000)]
    for text in texts:
        text = unicodedata.normalize("NFC", text).lower()
        assert found(text) == regex.findall(pattern, text)
    # Classes outside a set, or others, are left to regex.
    for other in (r"\p{L}+|.", r"[\p{Lu}]+|."):
        assert not isinstance(idfiles._finder(other).__self__, re.Pattern)


def test_settled_characters_by_both_ways(content):
    """Every settled character alone, behind a letter and before a sign; pairs of ASCII signs; case by case."""
    words, signs = idfiles.Words(content), [chr(c) for c in range(0x21, 0x7F)]
    settled = [chr(c) for c in range(0x21, 0x9FA6) if c < 0x4E00 or c % 50 == 0]
    settled = [c for c in settled if idfiles.SETTLED.fullmatch(c)]
    some = [*settled, *["q" + c for c in settled], *[c + "-" for c in settled], *[a + b for a in signs for b in signs]]
    some += ["don't", "I'LL'S'", "a'''ve9_9", "ÀÉ'TÑ", "Straße", "İstanbul", "Ǆungla", "東京9カ国", "Ёлка_1", "½x", "ª1"]
    assert [words._word(w.encode()) for w in some] == [np.array(i[:-1], "<u4").tobytes() for _, i in plain([(0, w) for w in some])]


@pytest.mark.parametrize("options", [{}, {"file_ids": 500}])
def test_files_of_odd_rows(spark, content, options):
    rows = [*brute.odd_rows(), *hard_texts()]
    docs = brute.documents(spark, rows).withColumn("dealt", F.lit("x")).withColumn("ids_le", F.lit("x"))
    back = idfiles.through_files(docs.repartition(5), content, 2, **options).collect()
    got = [(r["doc_id"], r["ids"]) for r in back]
    assert sorted(got, key=brute.key) == sorted(plain(rows), key=brute.key)
    back.sort(key=lambda r: r["start"])
    assert [r["n_tokens"] for r in back] == [len(r["ids"]) for r in back]
    assert [r["start"] for r in back] == np.cumsum([0, *(len(r["ids"]) for r in back)])[:-1].tolist()
    names = [brute.first_key(r["doc_id"]) for r in back]
    assert names == sorted(names)
    assert all(np.frombuffer(r["ids_le"], "<u4").tolist() == r["ids"] for r in back)
    empty = idfiles.through_files(brute.documents(spark, []), content, 2)
    assert empty.collect() == []


def test_files_and_reading_tasks_of_any_size(spark, tmp_path):
    rows = [(d, [draw % 70_000 for draw in range(d, d + d % 7)]) for d in range(-50, 250)]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    path = str(tmp_path / "ids")
    idfiles.write(tokens, path, width=4, file_ids=100)
    listed = json.loads((tmp_path / "ids" / "manifest.json").read_text())
    assert listed["docs"] == 300 and len(listed["files"]) >= 9 and listed["ids"] == sum(len(i) for _, i in rows)
    for split in (1, 37, 10**6):
        back = idfiles.read(spark, path, split_ids=split)
        assert sorted((r["doc_id"], r["ids"]) for r in back.collect()) == rows
    # A later writing without success leaves what is published as it is.
    with pytest.raises(Exception, match="does not fit"):
        idfiles.write(tokens, path, width=2)
    assert json.loads((tmp_path / "ids" / "manifest.json").read_text()) == listed
    with pytest.raises(Exception, match="ascending"):
        idfiles.write(tokens.coalesce(1).orderBy(F.desc("doc_id")), path, width=4)


def test_file_that_is_none(tmp_path):
    (tmp_path / "x").write_bytes(b"no ids" * 20)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file, pytest.raises(ValueError):
        idfiles.Footer.read(file)


def test_query_against_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, start = [], 0
    for d, ids in plain(sorted(brute.table_rows(docs))):
        want.append((d, start, len(ids), digest(ids)))
        start += len(ids)
    got = queries.QUERIES["op11_token_files"](spark, folder).collect()
    assert sorted(map(tuple, got)) == want
