import random
import re

import pytest
from pyspark.sql import functions as F

from riverlake.llm.license_scan import (
    RELATED,
    TEMPLATES,
    WINDOW,
    scan_licenses,
    template_bands,
    template_shingles,
)
from tests.llm.helpers import docs, sentence


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, templates=TEMPLATES):
    s = shingles(text)
    longest = max(len(set(shingles(t))) for _, t in templates)
    found = set()
    for name, template in templates:
        own = set(shingles(template))
        for at in range(0, len(s), 4):
            near = set(s[max(0, at - longest) : at + 4 + longest])
            if len(own & near) >= 0.75 * len(own):
                found.add(name)
    return sorted(found)


def result(df):
    return {r.doc_id: r.licenses for r in df.collect()}


def test_licenses_equal_brute_force(spark):
    texts = [f"{sentence(i, i % 23)} {t.upper() if i % 2 else t} {sentence(i + 99, 30)}" for i, (_, t) in enumerate(TEMPLATES * 6)]
    texts += [sentence(1, 200), None, "", "MIT License", "Released  under\nthe MIT\tlicense!", "the MIT License released under"]
    mit = TEMPLATES[-3][1].split()
    texts += [" ".join(w if i != 11 else "other" for i, w in enumerate(mit)), " ".join(mit[:12]), texts[0]]
    texts += ["word " * 50_000 + TEMPLATES[0][1] + " word" * 1000]
    table = docs(spark, texts, shingles=F.lit(1), licenses=F.lit("x"))
    assert result(scan_licenses(table)) == {i: brute(t) for i, t in enumerate(texts)}


def test_single_shingles_are_retrieved(spark):
    """Templates of one shingle, anywhere in a text."""
    templates = [(f"L{i}", sentence(i, 5)) for i in range(400)]
    texts = [f"{sentence(1000 + i, 3 + i % 4)} {t} {sentence(2000 + i, 9)}" for i, (_, t) in enumerate(templates)]
    found = result(scan_licenses(docs(spark, texts), templates))
    assert found == {i: [f"L{i}"] for i in range(400)}


def test_edited_templates_are_retrieved(spark):
    """Recall against brute force of templates of 4 to 40 shingles with as many edits as they bear."""
    rng = random.Random(5)
    templates = [(f"L{i:03}", sentence(i, 8 + i % 37)) for i in range(300)]
    texts = []
    for i, (name, said) in enumerate(templates):
        words, own = said.split(), set(shingles(said))
        for _ in range(20):
            other = list(words)
            at = rng.randrange(len(other))
            rng.choice([lambda: other.insert(at, "new"), lambda: other.pop(at), lambda: other.__setitem__(at, "new")])()
            if len(own & set(shingles(" ".join(other)))) >= 0.75 * len(own):
                words = other
        texts.append(f"{sentence(1000 + i, i % 5)} {' '.join(words)} {sentence(2000 + i, 9)}")
    found = result(scan_licenses(docs(spark, texts), templates))
    want = {i: brute(t, [templates[i]]) for i, t in enumerate(texts)}
    assert all(want.values())
    assert sum(found[i] == want[i] for i in want) >= 0.97 * len(want)


def test_bands_are_those_of_template_windows(spark):
    bands = template_bands(spark, [[5, 3, 9], [1, 2, 3, 4, 5], [2, 3, 4, 5]])
    assert [b for b in bands if b[0] == 0] == [(0, -1, 3)]
    one, two = ({b[1:] for b in bands if b[0] == t} for t in (1, 2))
    assert two < one and len(two) == 8 and WINDOW == 4


def test_only_dataframe_operations(spark):
    plan = scan_licenses(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_templates_and_empty_tables(spark):
    with pytest.raises(ValueError, match="fewer than 5 words"):
        template_shingles(spark, [("x", "too short")])
    assert result(scan_licenses(docs(spark, ["a b c d e f"]), [])) == {0: []}
    assert scan_licenses(docs(spark, [])).collect() == []


def test_version_and_family_words_decide(spark):
    every = TEMPLATES + RELATED
    texts = [f"{sentence(i, i % 23)} {t} {sentence(i + 99, 30)}" for i, (_, t) in enumerate(every)]
    assert result(scan_licenses(docs(spark, texts))) == {i: [name] for i, (name, _) in enumerate(every)}


def test_notices_side_by_side_are_all_found(spark):
    gpl3, gpl2 = TEMPLATES[6][1], next(t for name, t in RELATED if name == "GPL-2.0")
    short = "This work is licensed under the GNU General Public License, version "
    texts = [f"{gpl2} {gpl3}", f"{gpl3} {sentence(1, 9)} {gpl2}", f"{short}2. {short}3.", f"{TEMPLATES[8][1]} {TEMPLATES[0][1]}"]
    both = ["GPL-2.0", "GPL-3.0"]
    assert result(scan_licenses(docs(spark, texts))) == {0: both, 1: both, 2: both, 3: ["Apache-2.0", "MIT"]}
