"""What encoding costs besides the encoding: look-ups of remembered pieces, counts of ids."""

import time

import numpy as np
from tokenizers import Tokenizer

from larkspan.llm import bpe, token_files
from larkspan.llm.registry import vocabulary


def _made(pieces):
    return [7] * len(pieces), list(range(1, len(pieces) + 1))


def test_a_look_up_does_not_go_through_all_remembered_pieces():
    def seconds(remembered):
        pieces = bpe.Pieces(_made)
        pieces.learn({f" {i}" for i in range(remembered)})
        asked, best = {" 1", " 2"}, 9.0
        for _ in range(20):
            began = time.perf_counter()
            pieces.learn(asked)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(200_000) < 50 * seconds(10) + 0.0005


def test_old_pieces_come_back_without_being_made_again(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    asked = []
    pieces = bpe.Pieces(lambda x: (asked.extend(x), _made(x))[1])
    for wanted in ({"a", "b", "c"}, {"d", "a"}, {"e", "a", "b"}):
        pieces.learn(wanted)
        assert all(pieces.now[p] == np.array([7], "<u4").tobytes() for p in wanted)
    assert sorted(asked) == ["a", "b", "c", "d", "e"]


def test_counts_come_with_the_tokens(spark):
    texts = ["one two two", None, "", "zwei über zwei", "two <|endoftext|> two", "two \n \x1c two"]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = token_files.tokenised(docs, vocabulary(), 0, "doc_id", "text")
    library, want = Tokenizer.from_file(vocabulary()), {}
    for t in texts:
        for i in [*library.encode(t or "", add_special_tokens=False).ids, 0]:
            want[i] = want.get(i, 0) + 1
    ranks = token_files.frequency_ranks(rows.select("counts"))  # of the counts alone
    order = sorted(want, key=lambda i: (-want[i], i))
    assert [int(i) for i in np.argsort(ranks)[: len(order)]] == order and (ranks != token_files.UNUSED).sum() == len(order)
    got = {r["doc_id"]: r["n"] for r in rows.where("counts IS NULL").collect()}
    assert got == {None if i == 3 else i: 1 + len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_new_pieces_are_not_cut_again(monkeypatch):
    import tokenizers

    class Model:
        def __init__(self, source):
            self.model = Tokenizer.from_str(source).model

        def __getattr__(self, name):
            raise AssertionError(f"{name} of the whole library")

    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_str": staticmethod(Model)}))
    token_files._WORKER.clear()
    try:
        pieces, library = [" zwei", "\n", "\n\n", "über", " 日本", "'s", " \x1c", "!?"], Tokenizer.from_file(vocabulary())
        ids, ends = token_files._encoder(bpe.read_vocabulary(vocabulary())).pieces.make(pieces)
        want = [library.encode(p, add_special_tokens=False).ids for p in pieces]
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want
    finally:
        token_files._WORKER.clear()


def test_how_many_pieces_are_remembered_is_the_encoders_choice():
    asked = []
    pieces = bpe.Pieces(lambda x: (asked.extend(x), _made(x))[1], 2)
    for wanted in ({"a", "b"}, {"c", "d"}, {"e"}, {"a"}):  # the third lets go of a and b
        pieces.learn(wanted)
    assert sorted(asked) == ["a", "a", "b", "c", "d", "e"]
    assert token_files._encoder(bpe.read_vocabulary(vocabulary())).pieces.most == token_files.PIECES > bpe.PIECES


def test_only_the_encoder_that_needs_them_makes_the_tables_of_ranks():
    token_files._WORKER.clear()
    codes = token_files._encoder(bpe.read_vocabulary(vocabulary())).codes
    assert not {"real", "longest", "shorter"} & set(vars(codes))
    want = Tokenizer.from_file(vocabulary()).encode(" thattionble", add_special_tokens=False).ids
    assert [codes.id[t] for t in codes.ranks(b" thattionble")] == want


def test_packing_costs_a_few_passes_over_the_ids():
    r = np.random.default_rng(5)
    ranks = np.where(r.random(1 << 18) < 0.15, r.integers(256, 50_000, 1 << 18), r.integers(0, 256, 1 << 18)).astype("<u4")

    def seconds(run):
        best = 9.0
        for _ in range(7):
            began = time.process_time()
            run()
            best = min(best, time.process_time() - began)
        return best

    # A mask over the bytes of all ids, a part of what was done before, costs three to four times as much.
    mask = seconds(lambda: ranks.view(np.uint8).reshape(-1, 4)[:, :2][np.arange(2) <= (ranks > 255)[:, None]])
    assert seconds(lambda: token_files.pack(np.array([len(ranks)]), ranks)) < mask


def test_blocks_are_read_without_being_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3)
    texts = ["one two two", None, "", "zwei über zwei", "two <|endoftext|> two", "two \n \x1c two", "five six seven eight"]
    docs = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    token_files.write_token_files(docs, f"{tmp_path}/files", vocabulary())
    rows = token_files.read_token_files(spark, f"{tmp_path}/files")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    library, start, want = Tokenizer.from_file(vocabulary()), 0, []
    for i in range(len(texts) - 1, -1, -1):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want.append((-i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in rows.collect()) == want
