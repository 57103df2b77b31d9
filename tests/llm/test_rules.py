from collections import Counter

from quadweave.llm import rules


def brute(text):
    """Straight from the definitions, one loop each."""
    text = text or ""
    words, cur = [], ""
    for c in text + " ":
        if c in "\t\n\x0b\x0c\r ":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in "\t\n\x0b\x0c\r " for c in x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside)


def test_report_matches_brute_force(docs_of, hard_texts):
    rows = rules.quality_report(docs_of(list(enumerate(hard_texts)))).collect()
    assert len(rows) == len(hard_texts)
    for r in rows:
        n, chars, symbols, dups, repeated = expected = brute(hard_texts[r["doc_id"]])
        assert tuple(r)[1:6] == expected
        failed = n < 50 or 100 * repeated > 50 * n
        assert r["base_failed"] == failed
        if failed:
            assert not r["kept"]


def test_order_of_rules_changes_cost_not_the_verdict(docs_of):
    texts = ["word " * 30, "### " * 60 + "word " * 60, " ".join(f"clean{i}" for i in range(80)), None]
    docs = docs_of(list(enumerate(texts)))
    kept = {r["doc_id"] for r in rules.quality_filter(docs).collect()}
    assert kept == {2}
    assert rules.quality_filter(docs).columns == docs.columns
    for cascade in (rules.RULES, rules.RULES[::-1]):
        assert [i for i, t in enumerate(texts) if rules.first_rejection(rules.Text(t), cascade) is None] == [2]


def test_rules_are_ordered_by_rejections_per_second():
    def rule(name):
        f = lambda t: True
        f.__name__ = name
        return f

    cheap, strong, idle = rule("cheap"), rule("strong"), rule("idle")
    estimates = [
        {"rule": "idle", "rows": 10, "rejected": 0.0, "seconds": 0.001},
        {"rule": "strong", "rows": 10, "rejected": 0.5, "seconds": 1.0},
        {"rule": "cheap", "rows": 10, "rejected": 0.1, "seconds": 0.01},
    ]
    assert [r.__name__ for r in rules.ordered(estimates, (idle, strong, cheap))] == ["cheap", "strong", "idle"]


def test_a_text_leaves_at_the_first_rejection():
    called = []
    first = lambda t: called.append(1) or True
    second = lambda t: called.append(2) or True
    rules.first_rejection(rules.Text("x"), (first, second))
    assert called == [1]


def test_estimates_and_empty_tables(docs_of):
    docs = docs_of([(1, "a"), (2, "word " * 60)])
    by_name = {e["rule"]: e for e in rules.estimate(docs)}
    assert by_name["few_words"]["rejected"] == 0.5 and by_name["few_words"]["rows"] == 2
    empty = docs.limit(0)
    assert rules.quality_report(empty).count() == 0 and rules.quality_filter(empty).count() == 0


def test_repeated_rows_and_null_ids(docs_of):
    rows = rules.quality_report(docs_of([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == [(0, 0), (1, 2), (1, 2)]


def test_vowel_signs_are_letters():
    for text in ("हिन्दी में लिखी हुई किताबें और कविताएँ", "বাংলা ভাষায় লেখা কবিতা ও গল্প", "e\u0301te\u0301"):
        t = rules.Text(text)
        assert t.n_letters == t.word_chars and not rules.few_letters(t)
    for symbols in ("\u0915\u093f 1234 5678", "%%% ### 12"):
        assert rules.few_letters(rules.Text(symbols))
