"""Spelling variants, token alignment and quality rules against plain versions."""

import random

import public_tokenizers
import pytest

import plain
from motorlot.llm import alignment, quality_rules, spelling

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(9001, None), (9002, ""), (9003, "x▁y"), (9004, "<|endoftext|> hi <s> </s> <unk>"), (9005, "日本語のテキスト 🎉🎉 ŧŋ\x00\x01"),
       (9006, " a  b   c"), (9007, "\n\n\t x"), (9008, "a" * 2000), (9009, " "), (None, "abc def"), (9010, "x�y"), (9011, "ab" + " " * 700 + "c"), (9012, "²½ª x it's 12 ARÑ!!")]


def rows_of(df):
    return sorted(map(str, [tuple(r) for r in df.collect()]))


def stored(spark, folder, n):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where(f"doc_id < {n}").collect()]


def test_variants(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(120))) for i in range(40)]
    rows += [(100, "Wonderful wonderful " * 40 + "wonderfull wonderfull wonderfl wonderfl xonderful xonderful"), (101, None), (102, ""), (None, "nullable nullable"), (100, "repeated repeated")] * 2
    assert rows_of(spelling.variants(make_docs(rows))) == sorted(map(str, plain.variants(rows)))


def test_variants_of_long_words_and_chains(make_docs):
    rng = random.Random(6)
    x = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words = [x, x[:100] + "z" + x[101:], x[:50] + x[51:], x + "q", x + "qq", *[x[:n] for n in range(30, 36)], x[:20] + "x" + x[21:32], x[:20] + "y" + x[21:33], x[:5] + "y" + x[5:32]]
    rows = [(200 + k, " ".join(words)) for k in range(3)]
    rows += [(300 + k, "aaaaaaa " * 4000 + "aaaaaab " * 300 + "aaaaabb " * 20 + "aaaabbb " * 2 + "aaaaaac " * 4000) for k in range(3)]
    got = rows_of(spelling.variants(make_docs(rows)))
    assert got == sorted(map(str, plain.variants(rows)))
    assert any("'aaaabbb', 'aaaaabb', 'aaaaaa" in x for x in got)


def test_levels_beyond_the_limit_find_the_same(make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(7, 14))) for _ in range(200))) for i in range(8)]
    assert rows_of(spelling.variants(make_docs(rows), longest=9)) == sorted(map(str, plain.variants(rows)))


def test_alignment(spark, folder, make_docs):
    rows = [(i, (t or "")[:2500]) for i, t in stored(spark, folder, 60)] + ODD + ODD[:4]
    got = alignment.scored(make_docs(rows).repartition(3), A, B, chunk_bytes=20_000)
    assert rows_of(got) == sorted(map(str, plain.alignments(rows, A, B)))


def test_whole_texts_are_encoded_as_by_the_libraries(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    texts = [t for _, t in stored(spark, folder, 200) if t and "▁" not in t] + [t for _, t in ODD if t and "▁" not in t]
    with open(A) as x, open(B, "rb") as y:
        tools = alignment.loaded(x.read(), y.read())
    assert tools.ranks is not None
    assert [tools.encode_a(" " + t) for t in texts] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert tools.encode(texts)[1] == b.encode(texts)


def test_pointers_reach_the_end_of_a_long_group():
    import numpy as np

    n = 5000
    a_ends, b_ends = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n - 1, 2), 2 * n)
    a_last, b_last = alignment.terminals(a_ends, b_ends)
    assert set(a_last) == {len(b_ends) - 1} and set(b_last) == {len(b_ends) - 1}


def test_rule_measures(spark, folder, make_docs):
    rows = stored(spark, folder, 200) + [(9001, None), (9002, ""), (9003, " \n\t\n"), (9004, "a b c a b c " * 9000), (9005, "a b\n a b\na b\n\n\n" + "c " * 60), (None, "#x *y"), (9004, "a b")]
    got = quality_rules.judged(make_docs(rows))
    measures = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(measures) == sorted(map(str, plain.rule_measures(rows)))
    assert got.where("kept and (base_failed or size(failed) > 0)").isEmpty()


@pytest.mark.parametrize("text, failed", [
    ("the one of " + " ".join(f"word{i}" for i in range(80)), []),
    ("the of " + " ".join(f"w{i} #" for i in range(80)), ["mean word length", "symbols to words"]),
    (" ".join(f"word{i}" for i in range(80)), ["stop words"]),
    ("the of " + "\n".join(f"- word{i}" for i in range(80)) , ["mean word length", "bullet lines"]),
    ("\n".join(["the of words..."] * 3 + [f"word{i} and the other{i}" for i in range(6)] + ["more" * 2 + str(i) for i in range(40)]), []),
    ("\n".join(f"the word{i} and that{i}..." for i in range(40)), ["lines that break off"]),
])
def test_rules(make_docs, text, failed):
    assert quality_rules.judged(make_docs([(1, text)])).first()["failed"] == failed


def test_rule_table_is_a_parameter(make_docs):
    docs = make_docs([(1, "the of " + " ".join(f"word{i}" for i in range(80)))])
    none, few = quality_rules.judged(docs, ()), quality_rules.judged(docs, (quality_rules.Rule("few words", "n_words", high=10),))
    assert none.first()["kept"] and few.first()["failed"] == ["few words"]


@pytest.mark.parametrize("lengths, want", [
    ([], []),
    ([0, 0], [(0, 2, True)]),
    ([5, 5, 5, 5, 5], [(0, 2, False), (2, 4, True), (4, 5, True)]),
    ([50, 1, 9], [(0, 1, True), (1, 3, True)]),
    ([1] * 25, [(0, 10, False), (10, 20, True), (20, 25, True)]),
])
def test_pieces_of_chunks(lengths, want):
    """No piece holds more than its length and one text, chunks end where they did without pieces."""
    assert list(alignment.pieces(lengths, 20, 10)) == want


def test_pieces_change_nothing(make_docs):
    rows = [(i, f"token number {i} of a text " * (i % 9)) for i in range(300)]
    seen = [sorted(map(str, alignment.scored(make_docs(rows).coalesce(1), A, B, chunk_bytes=n).collect())) for n in (2_000, 1 << 21)]
    assert seen[0] == seen[1]
