import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidestream.llm.tokens import TokenCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(open(PATH, encoding="utf-8").read())
ODD = ["'re", "don't", "ÀΣΑΣ", "İstanbul", "é", "ẞ", "日本語", "<|endoftext|>", "<|startoftext|", "\x1c", "\x85", " ", "​", "½", "१२", "🙂🙂", "a" * 300, "A-b_c", "\x00", "ﬁ", "K", "ͅα"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=12), st.from_regex(r"[a-z]{1,14}", fullmatch=True)), max_size=12), st.sampled_from(["", " ", "\n", "　"]))
def test_counts_equal_the_library(parts, gap):
    text = gap.join(parts)
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_characters_of_any_age_count_as_the_library_has_them():
    """Each beside a letter, a mark and a digit: its class decides where words end."""
    for block in (*range(0, 0x3400), *range(0xA700, 0xABF0), *range(0x10100, 0x12700), *range(0x16E00, 0x19200), *range(0x1B100, 0x1B200), *range(0x1D600, 0x1E700), *range(0x2B700, 0x2B900, 7), *range(0x2CE90, 0x2CEC0), *range(0x32300, 0x33500, 61), *range(0x3CF00, 0x3FD00, 211)):
        text = f"a{chr(block)}!{chr(block)}1"
        assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), hex(block)


def test_rows(spark):
    long = "xyz" * 50_000
    rows = [(1, "Hello world", 9), (1, "Hello world", 9), (2, None, 0), (3, "", 0), (4, " \n", 0), (5, long, 0), (None, "é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts(df, PATH).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, _ in rows), key=str)
    assert got == want
    assert token_counts(df.limit(0), PATH).count() == 0
