import random
import re
from collections import Counter

from quern.llm import repetition


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered), failed


def shares(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    total, worst = sum(map(len, words)), 0.0
    for n in repetition.DUPLICATE_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        c = Counter(grams)
        covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + n)}
        worst = max(worst, sum(len(words[j]) for j in covered) / total if total else 0.0)
    return worst


def samples():
    rng = random.Random(8)
    out = ["", " \n\t ", "one", "\x1c \xa0x", "é#" * 30, "a b c d e f g h " * 12, "same line\nsame line\n\nsame line\n"]
    for _ in range(150):
        vocabulary = ["a", "bb", "#", "é", "日本", "\n", "x\ty", "  ", "c|d", "\x0b", "word"][: rng.randint(2, 11)]
        out.append(rng.choice([" ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 120))))
    return out


def test_counts_against_brute_force(spark):
    values = [*samples(), None, "w " * 60000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(values)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in repetition.quality(docs).collect()}
    for i, t in enumerate(values):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t or ""), (i, t)
        assert abs(r.dup_ngram_share - shares(t or "")) < 1e-9 if i < 60 else True
        assert not (r.base_failed and r.kept)
    assert repetition.quality(docs.limit(0)).count() == 0


def test_verdict():
    clean = " ".join(f"w{i}" for i in range(60))
    junk = clean + " " + " ".join(f"r{i % 7}" for i in range(30))
    got = repetition.measure_all([clean.encode(), junk.encode(), " ".join(["x#"] * 3 + [f"y{i}$" for i in range(40)]).encode()])
    assert [r["kept"] for r in got] == [True, False, False]
