"""BPE with reuse, attribution, id files."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import attribution, bpe_reuse, id_files
from larkspan.llm.bpe import Bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, VOCAB = Tokenizer.from_file(PATH), Bpe(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


PIECES = st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "the", " The", "don't", "'ll", "é", "日本", "🙂", "!!", "...", "1234", "a" * 1200, " " * 1100, "<|endoftext|>", "\r\n", "_", "ß", "́"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=14).map("".join)))
def test_encoder_agrees_with_the_library(text):
    ids = VOCAB.encode(text).tolist()
    assert ids == library(text)
    assert VOCAB.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert VOCAB.ranks is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECES, max_size=30).map(lambda p: "".join(p) * 9))
def test_bodies_join_to_the_whole(text):
    if not VOCAB.has_special(text):
        memory = bpe_reuse.Memory({}, VOCAB)
        assert bpe_reuse.joined(text, memory).tolist() == library(text) == bpe_reuse.joined(text, memory).tolist()


def test_other_vocabularies_use_the_library():
    other = Bpe(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some words, in lower case"
    assert other.ranks is None
    assert other.encode(text).tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_encoding_whole_tables(awkward, documents, nothing):
    for df in (awkward, documents):
        got = bpe_reuse.encode_documents(df, PATH)
        digests = bpe_reuse.encode_digests(df, PATH).collect()
        want = sorted(((r.doc_id, library(r.text or "")) for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == want
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests), key=repr) == sorted(
            ((i, len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for i, x in want), key=repr)
    back = bpe_reuse.decode_documents(bpe_reuse.encode_documents(awkward, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=repr)
    assert bpe_reuse.encode_documents(nothing, PATH).count() == 0


def test_chunks_repeat_in_shared_passages():
    rng = np.random.default_rng(1)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(3000))
    one, two = ({bpe_reuse.body_key(t[a:b]) for a, b in bpe_reuse.bodies(t)} for t in (passage, "another start, and then " * 9 + passage))
    assert len(one & two) > 0.8 * len(one)


def test_token_spans_follow_the_library():
    for text in ("plain words here.", "日本語 🙂 ok", "  two  blanks\n\nand é"):
        starts, ends = attribution.token_spans(text, VOCAB)
        offsets = LIBRARY.encode(text, add_special_tokens=False).offsets
        for (a, b), (x, y) in zip(zip(starts, ends), offsets):
            assert b == y and (a == x or text[a:x].isspace())  # the library leaves leading blanks out


def brute_allocation(spans, sections, rule):
    tokens, share, crossing = {}, {}, {}
    for a, b in spans:
        homes = [next((i for i, (x, y) in enumerate(sections) if x <= p < y), -1) for p in range(a, b)]
        tiles = [(homes[0], 1)]
        for h in homes[1:]:
            tiles = [*tiles[:-1], (h, tiles[-1][1] + 1)] if h == tiles[-1][0] else [*tiles, (h, 1)]
        home = {"start": tiles[0][0], "end": tiles[-1][0], "majority": max(tiles, key=lambda t: t[1])[0]}[rule]
        tokens[home] = tokens.get(home, 0) + 1
        for h, n in tiles:
            share[h] = share.get(h, 0) + n / (b - a)
        for h in {h for h, _ in tiles}:
            crossing[h] = crossing.get(h, 0) + (len(tiles) > 1)
    return tokens, share, crossing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=20), st.lists(st.integers(0, 70), max_size=8), st.sampled_from(attribution.RULES))
def test_allocation_against_brute_force(widths, edges, rule):
    ends = np.cumsum(widths)
    edges = sorted(edges[: len(edges) // 2 * 2])
    sections = list(zip(edges[::2], edges[1::2]))
    tokens, share, crossing = brute_allocation(list(zip(ends - widths, ends)), sections, rule)
    got = {r[0]: r for r in attribution.allocate(ends - widths, ends, sections, rule)}
    for i in {*tokens, *share, *got}:
        row = got.get(i, (i, 0, 0, 0, 0, 0.0))
        assert (row[3], row[4]) == (tokens.get(i, 0), crossing.get(i, 0)) and row[5] == pytest.approx(share.get(i, 0))


def test_attribution_tables(awkward, documents, nothing):
    for rule in attribution.RULES:
        got = attribution.attribute_sections(awkward, PATH, rule).toPandas()
        assert len(got[got.doc_id == 4]) == 1 and (got[got.doc_id == 4].section == -1).all()
    got = attribution.attribute_sections(documents, PATH).toPandas().groupby("doc_id")
    want = {r.doc_id: (len(library(r.text)), len(r.text.splitlines()) if "\n" in r.text else 1) for r in documents.collect()}
    assert {i: int(n) for i, n in got.n_tokens.sum().items()} == {i: n for i, (n, _) in want.items()}
    assert np.allclose(got.token_share.sum(), got.doc_tokens.first())
    fields = attribution.attribute_fields(awkward, PATH, ["source", "lang", "text"]).toPandas()
    assert len(fields[(fields.doc_id == 8) & fields.field.notna()]) == 3
    one = fields[fields.doc_id == 8]
    assert one.n_tokens.sum() == len(library("c\nde\n" + "der hund und die katze " * 20)) == one.doc_tokens.iloc[0]
    assert attribution.attribute_sections(nothing, PATH).count() == 0 == attribution.attribute_fields(nothing, PATH, ["text"]).count()
    with pytest.raises(ValueError):
        attribution.allocate(np.array([0]), np.array([1]), [(2, 4), (3, 5)], "start")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, (1 << 17) - 1)), max_size=80), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    coded = id_files.encode_blocks(blocks, 17)
    back = id_files.decode_blocks(id_files.split_blocks(b"".join(coded)), 17)
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]
    # a block stands alone
    assert id_files.decode_blocks(id_files.split_blocks(coded[-1]), 17)[0].tolist() == blocks[-1].tolist()


def test_coder_compresses_and_finds_damage():
    ids = np.tile(np.arange(40), 50)[: id_files.BLOCK].astype(np.int64)
    (coded,) = id_files.encode_blocks([ids], 17)
    assert len(coded) < len(ids) / 4
    broken = bytearray(coded)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        id_files.decode_blocks(id_files.split_blocks(bytes(broken)), 17)
    with pytest.raises(ValueError):
        id_files.split_blocks(coded[:-3])


def test_id_files(spark, awkward, documents, nothing, tmp_path, monkeypatch):
    for name, df in (("awkward", awkward), ("documents", documents)):
        id_files.write_ids(df, PATH, str(tmp_path / name))
        got = id_files.read_ids(spark, str(tmp_path / name), with_ids=True).collect()
        rows = df.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, library(r.text or "") + [2]) for r in rows), key=repr)
        assert sorted(((r.id, r.ids) for r in got), key=repr) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            at += r.n_tokens
        order = [r.id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i))
    id_files.write_ids(nothing, PATH, str(tmp_path / "nothing"))
    assert id_files.read_ids(spark, str(tmp_path / "nothing")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"x", b" ", b"\n", b"\xc3\xa9", b"a b"]), st.integers(1, 1100)), max_size=6))
def test_long_runs_are_found(parts):
    from larkspan.llm.bpe import LONG_RUN, long_run

    raw = b"".join(p * n for p, n in parts)
    longest = max((len(r) for r in re.findall(rb"[ \t-\r]+|[^ \t-\r]+", raw)), default=0)
    assert long_run(raw) == (longest > LONG_RUN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "the", "don't", "'ll", "é", "日本", "!!", "12", "_"]), max_size=12).map("".join))
def test_single_blanks_need_no_look_ahead(text):
    from larkspan.llm.bpe import single_blanks

    found = single_blanks(text.encode())
    assert not (found and re.search(r"\s\s", text))
    if found:
        assert VOCAB.plain.encode_ordinary(text) == VOCAB.ranks.encode_ordinary(text) == VOCAB.encode(text).tolist() == library(text)
    if text.isascii() and not re.search(r"[\x00-\x20]{2}", text):
        assert found


def test_carries_pass_over_full_digits():
    """A carry goes through digits that are full, in its own lane only."""
    coder = id_files.Encoder(2, 8)
    digits = coder.digits.reshape(8, 2)
    digits[:3] = [[7, 7], [0xFFFF, 0xFFFF], [0xFFFF, 0xFFFF]]
    digits[2, 1] += 1
    coder.at += 3 * 2
    assert [w.tolist() for w in coder.finish()] == [[7, 0xFFFF, 0xFFFF, 0, 0], [8, 0, 0, 0, 0]]


@pytest.mark.parametrize("bits", [16, 17, 18, 20])
def test_ids_of_many_bits(bits):
    """Ids with more than 16 bits after their size class are read back."""
    rng = np.random.default_rng(bits)
    blocks = [np.array([0, 3, 255, (1 << bits) - 1, 1]), rng.integers(1 << (bits - 1), 1 << bits, 300), np.tile([(1 << bits) - 1, 5], 100)]
    back = id_files.decode_blocks(id_files.split_blocks(b"".join(id_files.encode_blocks(blocks, bits))), bits)
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=40, max_size=40), min_size=1, max_size=4))
def test_writer_expects_what_the_reader_finds(rows):
    """What is found for whole blocks at once is what a reader finds id by id."""
    ids = np.array(rows, np.uint32)
    last = id_files.Followers(len(ids))
    for t, state in enumerate(id_files.followed(ids).T):
        plus_one = ids[:, t] + np.uint32(1)
        assert (state & 15).tolist() == last.look(len(ids)).tolist()
        hit2 = plus_one == last.next2
        assert (state & 16 != 0).tolist() == hit2.tolist() and (state & 32 != 0).tolist() == (plus_one == last.next1).tolist()
        last.learn(len(ids), ids[:, t], plus_one, hit2)


def test_long_blocks_are_refused():
    with pytest.raises(ValueError):
        id_files.encode_blocks([np.zeros(id_files.BLOCK + 1, np.int64)], 17)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .'s\n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u1680\u200aé’漢\U0001f600"), max_size=14), max_size=8))
def test_texts_encoded_by_distinct_parts(texts):
    """Parts between blanks, each encoded once, give the ids of the whole texts."""
    texts = [*texts, "", "the dog  the dog the dog", " the dog<|endoftext|>", "a" * 1500 + " the dog", *texts]
    assert [ids.tolist() for ids in VOCAB.encode_all(texts)] == [library(t) for t in texts]
