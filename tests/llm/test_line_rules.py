import pytest
from helpers import frame, odd_texts, prose

from attesta.llm import line_rules


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A sentence.", None), ("He said “so.”", None), ("no mark", "punctuation"), ("Home | News | Sport | Contact.", "navigation"), ("Please ACCEPT Cookies now.", "boilerplate"),
        ("a%% b## c$$ d** .", "symbols"), ("One | two.", None), ("Done!)", None),
    ],
)
def test_rules(line, rule):
    assert line_rules.failing(line) == rule


def brute(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


@pytest.mark.parametrize("text", ["a b c d a b c", "a a a a a", "x y", "", "a b c a b c a b", prose(7, 200) + " " + prose(7, 30)])
def test_repeated_words(text):
    assert line_rules.repeat_words(text.encode().split()) == brute(text.encode().split())


def test_figures_and_verdicts(spark):
    good, bad = "\n".join(prose(i, 30) for i in range(4)), "\n".join(["Menu | a | b | c"] * 3 + [prose(9, 60)])
    nbsp = "a\u00a0b c."  # only ASCII white space separates words
    texts = [*odd_texts(), good, bad, nbsp]
    rows = {r.doc_id: r for r in line_rules.clean(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept and rows[3].clean_text == ""
    n = len(odd_texts())
    assert rows[n].kept and rows[n].clean_text == good
    assert rows[n + 1].n_dup_lines == 2 and rows[n + 1].n_failed_lines == 3 and rows[n + 1].clean_text == prose(9, 60)
    assert rows[n + 2].n_words == 2 and rows[n + 2].word_chars == 5
    assert rows[11].n_repeat_words == 400 and rows[11].base_failed
    assert line_rules.clean(frame(spark, [])).count() == 0


def test_documents_that_lose_too_much_go():
    text = "\n".join(prose(i, 8)[: None if i < 6 else -1] for i in range(12))
    figures, kept = line_rules.judge(text)
    assert not figures[5] and not figures[6] and kept.count("\n") == 5
