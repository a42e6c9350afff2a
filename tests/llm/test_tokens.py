"""Token counts, SentencePiece and packing against the libraries themselves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewire.llm.bytebpe import Encoder
from tidewire.llm.packing import Packer, pack_documents
from tidewire.llm.sentencepieces import PieceTable, encode_pieces, piece_digests
from tidewire.llm.tokencount import split_safely, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, sequence_id long, ids string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in texts], SCHEMA)


def test_counts_match_the_libraries(spark, bpe, pieces, odd_texts):
    tok, sp = Tokenizer.from_file(bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
    for path, count in ((bpe, lambda t: len(tok.encode(t, add_special_tokens=False).ids)), (pieces, lambda t: len(sp.encode(t)))):
        got = Counter(map(tuple, token_counts(rows(spark, odd_texts), path, part_chars=1000, batch_bytes=5000).collect()))
        assert got == Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in odd_texts)


def test_counts_of_an_empty_table(spark, bpe, pieces):
    for path in (bpe, pieces):
        out = token_counts(rows(spark, []), path)
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'é<|>1-日", max_size=60))
def test_parts_have_the_tokens_of_the_whole(text):
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = split_safely(text, 5)
    assert "".join(parts) == text
    assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab▁é<s>1-日ﬁ\x00", max_size=40))
def test_piece_table_is_the_library(text):
    import public_tokenizers

    table = PieceTable.of(public_tokenizers.path("piece_bpe_32k.model"))
    assert table.chunked
    want = table.sp.encode(text)
    (n, ids, decoded), = table.digests([text])
    assert table.encode(text) == want and n == len(want) and ids == ",".join(map(str, want)) and decoded == table.sp.decode(want)


def test_piece_digests(spark, pieces, odd_texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    want = Counter()
    for i, t in odd_texts:
        ids = sp.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, piece_digests(rows(spark, odd_texts), pieces).collect())) == want
    full = encode_pieces(rows(spark, odd_texts), pieces).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in full) == sorted((i or -1, sp.encode(t or "")) for i, t in odd_texts)
    assert piece_digests(rows(spark, []), pieces).count() == 0


def test_table_is_emptied_at_its_size(pieces):
    table = PieceTable(pieces, most=3)
    for k in range(5):
        assert [e[0] for row in table.rows([f"some new words {k}"]) for e in row]
    assert len(table.table) <= 8


def check_packing(out, texts, encode, capacity):
    want = Counter(tuple(encode(t or "")) + (1,) for _, t in texts)
    seqs = defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append(r)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return want, padding


def test_packing_holds_every_token_once(spark, bpe, odd_texts):
    tok = Tokenizer.from_file(bpe)
    texts = [(10 + k, t) for k, (_, t) in enumerate(odd_texts)] + [(100 + k, "several words here " * (k % 90)) for k in range(300)]
    out = pack_documents(rows(spark, texts).coalesce(1), bpe, capacity=256, window_tokens=4096, with_ids=True).collect()
    want, padding = check_packing(out, texts, lambda t: tok.encode(t, add_special_tokens=False).ids, 256)
    docs = defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
    got = Counter()
    for parts in docs.values():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert {r.doc_tokens for r in parts} == {sum(p.length for p in parts)}
        got[tuple(i for r in parts for i in r.ids)] += 1
    assert got == want
    assert padding < 256  # of one input partition, less than a sequence


def test_packing_edges(spark, bpe):
    assert pack_documents(rows(spark, []), bpe).count() == 0
    only = pack_documents(rows(spark, [(None, None), (3, "")]), bpe).collect()
    assert sorted(((r.doc_id or -1), r.length, r.doc_tokens) for r in only) == [(-1, 1, 1), (3, 1, 1)]
    twice = pack_documents(rows(spark, [(3, "a b"), (3, "a b")]), bpe).collect()
    assert len(twice) == 2


def test_a_file_of_another_kind_goes_to_its_library(tmp_path, bpe):
    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(other)
    assert Encoder.of(other).ids("Some words.").tolist() == tok.encode("Some words.", add_special_tokens=False).ids


def test_runs_that_a_pattern_gives_up_on(spark, bpe):
    tok = Tokenizer.from_file(bpe)
    texts = [(1, "a" + "\n" * 1_000_000 + "b"), (2, " " * 1_500_000), (3, "x" * 300_000), (4, "plain")]
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert {r.doc_id: r.n_tokens for r in token_counts(rows(spark, texts), bpe).collect()} == {i: len(v) for i, v in want.items()}
    got = defaultdict(list)
    for r in sorted(pack_documents(rows(spark, texts), bpe, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert got == {i: v + [1] for i, v in want.items()}


def test_batches_are_balanced_by_bytes(bpe, monkeypatch):
    from tidewire.llm import tokencount

    seen = []
    whole = Encoder.lengths
    monkeypatch.setattr(Encoder, "lengths", lambda self, batch: (seen.append(sum(len(t.encode()) for t in batch)), whole(self, batch))[1])
    texts = ["слово и ещё слово " * 40, "plain words here " * 40] * 50
    tokencount._lengths_json(bpe, texts, 10_000, 1 << 16)
    assert max(seen) <= 10_000 and min(seen[:-1]) > 7_000


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    packer = Packer(2048, 1.0, 1 / 2048)
    for k in range(4000):
        list(packer.add((k, 1), np.zeros(int(rng.integers(20, 900)), np.uint32)))
    seqs = list(packer.flush(last=True))
    fill = [sum(len(p[2]) for p in s) for s in seqs]
    cost = [sum(packer.cost(len(p[2])) for p in s) for s in seqs]
    assert sum(2048 - f for f in fill) < 2048
    assert np.percentile(cost, 95) / np.percentile(cost, 5) < 1.35


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(4, 16), st.booleans())
def test_packer_never_loses_a_token(sizes, capacity, flush_often):
    packer, out = Packer(capacity, 1.0, 0.1), []
    for k, n in enumerate(sizes):
        out += list(packer.add((k, n), np.arange(n, dtype=np.uint32)))
        if flush_often:
            out += list(packer.flush(last=False))
    out += list(packer.flush(last=True))
    got = defaultdict(list)
    for s in out:
        assert sum(len(p[2]) for p in s) <= capacity
        for (k, _), start, ids in s:
            assert ids[0] == start
            got[k] += ids.tolist()
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}
