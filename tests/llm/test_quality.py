import pytest

from codeloom.llm import quality as Q

GOOD = "This is the story of a man and his dog, who went to the sea with a friend of the family.\n"


@pytest.mark.parametrize(
    ("text", "failed"),
    [
        (GOOD * 3 + "One more line that is different from the others, and that is all there was to it.", ""),
        ("Short.", ""), ("", "word_count"), (None, "word_count"), (" \n\t", "word_count"),
        ("!!! ### $$$ %%% " * 20, "letter_ratio,symbol_ratio,stop_word_ratio,distinct_word_ratio"),
        ("SHOUTING WORDS HERE AND THERE OVER AND OVER AGAIN IN CAPITAL LETTERS", "capital_ratio"),
        ((GOOD * 12).strip(), "distinct_word_ratio,repeated_line_ratio"),
        ("- one item here\n- two items here\n- three items here\n- four items", "bullet_line_ratio"),
        ("this goes on...\nand so on ...\nit never ends…\nor does it, after all", "ellipsis_line_ratio"),
        ("x" * 2000, ""), ("abc def ghi " * 7000, "stop_word_ratio,distinct_word_ratio"),
    ],
)
def test_rules(table, text, failed):
    r = Q.evaluate(table([(1, text)])).collect()[0]
    assert (r.failed, r.keep) == (failed, failed == "")


def test_measures_equal_plain_python(table, corpus):
    rows = [*corpus, (900, GOOD * 2), (901, "a\x0bb\fc\r\nd"), (902, "f f of The THE"), (903, "- x\n* y\n\nz")]
    for r, (i, t) in zip(Q.evaluate(table(rows).coalesce(1)).collect(), rows, strict=True):
        t = t or ""
        w = t.split()
        dense = "".join(w)
        assert r.doc_id == i and r.word_count == len(w)
        if w:
            assert r.mean_word_length == len(dense) / len(w)
            assert r.stop_word_ratio == sum(x.lower() in Q.STOP_WORDS for x in w) / len(w)
            assert r.distinct_word_ratio == len({x.lower() for x in w}) / len(w)
            assert r.capital_ratio == sum("A" <= c <= "Z" for c in dense) / len(dense)
            assert r.letter_ratio == sum(c.isalpha() for c in dense) / len(dense)
        lines = t.split("\n")
        assert r.repeated_line_ratio == 1 - len(set(lines)) / len(lines)


def test_one_projection(table, capsys):
    Q.evaluate(table([(1, "a")])).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(table):
    assert Q.evaluate(table([])).collect() == []
