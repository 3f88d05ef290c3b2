"""License scans by a positional index of each template's rarest words.

Document frequencies of the templates' words are counted over all documents. Of every template the words of highest IDF
are posted with their positions, two of its key phrase among them. A text looks up its words; where two postings of a template (or the only one)
agree on the place at which the template would start, the template is laid there: its key phrase must
stand word for word, and the share of its words that agree is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import text_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RARE = 4  #: words of a template that are posted


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str  #: words in a row that must stand


#: Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

TEMPLATES = (
    *(Template(label, phrase, phrase) for phrase, label in BASE),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII."""
    return WORD.findall(text.encode().lower())


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents and how many hold each word: a row a word and task, then a row a word."""
    texts = docs.select(text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0):
                held.update(vocabulary.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in held)]), pa.array([n, *held.values()], pa.int64())], ["w", "n"])

    rows = texts.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the rarest words of each template and of its key phrase."""

    def __init__(self, templates: tuple[Template, ...], n: int, counts: dict[bytes, int], rare: int = RARE):
        idf = lambda w: math.log((n + 1) / (counts.get(w, 0) + 1))
        self.templates = [(t.label, words_of(t.words), words_of(t.key)) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, (_, words, key) in enumerate(self.templates):
            rank = lambda w: (-idf(w), w)
            needed = min(2, len(set(key)))
            # as many as have to agree come from the key phrase: where it stands, the template is found
            chosen = sorted(set(key), key=rank)[:needed]
            chosen += sorted(set(words).difference(chosen), key=rank)[: rare - needed]
            self.needed.append(needed)
            for at, w in enumerate(words):
                if w in chosen:
                    self.postings[w].append((k, at))
        self.known = frozenset(self.postings)

    def matches(self, words: list[bytes], present: set[bytes]) -> dict[tuple[int, int], float]:
        """(template, place of its first word): the share of its words that agree."""
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at, w in enumerate(words):
            if w in present:
                for k, place in self.postings[w]:
                    votes[k, at - place].add(w)
        out = {}
        for (k, start), agreed in votes.items():
            if len(agreed) < self.needed[k]:
                continue
            _, template, key = self.templates[k]
            from_key = start + next(i for i in range(len(template)) if template[i : i + len(key)] == key)
            if from_key >= 0 and words[from_key : from_key + len(key)] == key:
                out[k, start] = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template)
        return out


def scan_text(text: str, index: Index) -> tuple[int, list[tuple[int, str]], list[tuple[int, str, float]]]:
    """Number of words, base places (start, label) and template matches (start, label, share)."""
    words = words_of(text)
    present = index.known.intersection(words)
    found = index.matches(words, present) if present else {}
    base = sorted((start, index.templates[k][0]) for (k, start) in found if k < len(BASE))
    return len(words), base, [(start, index.templates[k][0], share) for (k, start), share in sorted(found.items())]


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, n_words, places (start, label of base phrases), matches (start, label, share of templates).

    The first templates are the base phrases; each is its own key phrase, so its matches are all the places
    where its words stand in a row. Starts count words from 0. Null text: empty, nothing found. Null ids and
    repeated rows are rows like any other; empty table: no rows; other columns are ignored.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.words))
    index = Index(templates, *document_frequencies(docs, vocabulary, text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    place, match = pa.struct([("start", pa.int64()), ("label", pa.string())]), pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, found = [], [], []
            for t in batch.column(1):
                k, b, m = scan_text(t.as_py(), index)
                n.append(k)
                base.append([{"start": s, "label": x} for s, x in b])
                found.append([{"start": s, "label": x, "share": v} for s, x, v in m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, pa.list_(place)), pa.array(found, pa.list_(match))], [id_col, "n_words", "places", "matches"])

    kind = T._parse_datatype_string("n_words bigint, places array<struct<start:bigint,label:string>>, matches array<struct<start:bigint,label:string,share:double>>")
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *kind.fields]))
