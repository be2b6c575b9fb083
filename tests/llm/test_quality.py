import re

from granary.llm import quality as Q

from .helpers import ODD, clashing, documents


def slow(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = {}, set()
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures(spark):
    texts = [*ODD, "### a|b <x>\nline\nline\n \n \nline", "a b c d " * 20, "α β γ δ"]
    rows = Q.quality_rules(clashing(documents(spark, texts))).collect()
    for r in rows:
        want = slow(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_verdict(spark):
    clean = " ".join(f"the word{i} of place{i}" for i in range(40))
    texts = [clean, " ".join(f"w{i}###" for i in range(80)), " ".join(f"WORD{i}!!" for i in range(80)), " | ".join(f"cell{i}" for i in range(80))]
    assert [r.kept for r in sorted(Q.quality_rules(documents(spark, texts)).collect())] == [True, False, False, False]


def test_native_plan(spark):
    plan = Q.quality_rules(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_empty_table(spark):
    assert Q.quality_rules(documents(spark, [])).count() == 0
