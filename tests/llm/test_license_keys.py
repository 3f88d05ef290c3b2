"""A template is found wherever its key phrase stands, whatever the corpus's frequencies."""

import random

from callgauge.llm import license_scan


def test_key_phrases_are_found_by_any_frequencies():
    rnd = random.Random(1)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in license_scan.words_of(t.words)})
    for _ in range(100):
        index = license_scan.Index(license_scan.TEMPLATES, 1000, {w: rnd.randint(0, 1000) for w in vocabulary})
        for k, t in enumerate(license_scan.TEMPLATES):
            *_, matches = license_scan.scan_text(" ".join(["one"] * 30 + [t.key] + ["two"]), index)
            assert t.label in {label for _, label, _ in matches}, (k, t.label)


def test_a_license_named_in_other_words(spark):
    rows = [(1, "licensed under the Mozilla Public License, version 2.0"), (2, "other words"), *((k, "a public license") for k in range(3, 20))]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").first()
    assert [m["label"] for m in found["matches"]] == ["mpl-2.0"]
