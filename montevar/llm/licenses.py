"""License scans: Aho-Corasick for tags and notices, a shunting-yard parser for license expressions.

One automaton finds all notice phrases in a text's normal form (lower case, words by one space), a second one
the identifier tags in the lowered text itself.  What follows a tag is read as an expression of
identifiers, ``and``, ``or``, ``with`` and brackets, turned into reverse Polish order by the shunting-yard method and
evaluated from left to right: ``or`` leaves the choice (the milder terms hold), ``and`` binds to both (the
stricter ones), ``with`` names an exception that softens strong copyleft.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from montevar.llm.common import per_process, portions, table

# Phrases of the contract and the labels they stand for.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further notices, the labels they stand for and how sure they are.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.95),
    "redistributions in binary form must reproduce the above copyright notice": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "mozilla public license v 2": ("mpl-2", 0.9),
    "eclipse public license": ("epl", 0.8),
    "boost software license version 1": ("bsl-1", 0.9),
    "apache license v2": ("apache-2", 0.8),
    "licensed under the apache license": ("apache", 0.8),
    "the mit license": ("mit", 0.6),
    "creative commons attribution": ("cc-by", 0.6),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution share alike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution non commercial": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc sa": ("cc-by-nc-sa", 0.7),
    "cc by nc nd": ("cc-by-nc-nd", 0.7),
    "cc0 1 0 universal": ("cc0-1", 0.9),
    "dedicated to the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
#: How sure a phrase of the contract and a well-formed expression behind a tag are.
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.98

# What license families ask for, from 0 (nothing but notice) to 3 (use itself is restricted).
TERMS = ("permissive", "weak-copyleft", "copyleft", "restricted")
FAMILIES = {"mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "bsl": 0, "unlicense": 0, "0bsd": 0, "cc0": 0, "cc-by": 0,
            "python": 0, "psf": 0, "wtfpl": 0, "postgresql": 0, "ncsa": 0, "artistic": 0, "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1,
            "eupl": 2, "gpl": 2, "agpl": 2, "cc-by-sa": 2, "cc-by-nd": 3, "cc-by-nc": 3, "cc-by-nc-sa": 3, "cc-by-nc-nd": 3,
            "proprietary": 3}
# Strings that stand before a license expression; those of the second kind also stand before prose.
TAGS = ("spdx-license-identifier:", "license-expression:")
LOOSE_TAGS = ("license:", "licence:", '"license":', "license =", "license=")

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TOKEN = re.compile(r"[ \t\"'`]*([()]|[a-z0-9][a-z0-9.+-]*)")
_VERSION = re.compile(r"-v?(\d+)(?:\.(\d+))*$")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def normal(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters (A-Z lowered) and all signs beyond ASCII."""
    return text.translate(_WORDS).split()


def label(identifier: str) -> tuple[str, int] | None:
    """Label and terms of a license identifier, or nothing if its family is unknown."""
    name = identifier.rstrip("+")
    for ending in ("-only", "-or-later"):
        name = name.removesuffix(ending)
    version = _VERSION.search(name)
    family = name[:version.start()] if version else name
    if family.startswith("bsd-"):
        family = "bsd"                                               # bsd-3-clause and its like keep their names
        return name, FAMILIES[family]
    if family not in FAMILIES:
        return None
    # Creative Commons licenses go by their conditions, the others by their main version.
    return (family if not version or family.startswith("cc-") else f"{family}-{version[1]}"), FAMILIES[family]


def postfix(text: str, at: int = 0) -> tuple[list[str], int]:
    """Shunting-yard: the expression at ``at`` in reverse Polish order, and where it ends.

    Reading ends at the first token that cannot go on; an operator without a right side is dropped, an open bracket
    closes at the end, a closing one without an open one ends the expression.
    """
    out, operators, operand, ends = [], [], True, at
    while (m := _TOKEN.match(text, at)) is not None:
        token = m[1]
        known = _PRECEDENCE.get(token)
        if operand and token == "(" and operators[-1:] != ["with"]:
            operators.append(token)
        elif operand and known is None and token not in "()":
            out.append(token.rstrip("."))
            operand, ends = False, m.end()
        elif not operand and token == ")" and "(" in operators:
            while (top := operators.pop()) != "(":
                out.append(top)
            ends = m.end()
        elif not operand and known is not None:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= known:
                out.append(operators.pop())
            operators.append(token)
            operand = True
        else:
            break
        at = m.end()
    if operand:
        # The last operator has no right side; brackets that nothing stands in fall with it.
        while operators and operators[-1] == "(":
            operators.pop()
        if out and operators:
            operators.pop()
    out += [top for top in reversed(operators) if top != "("]
    return out, ends


def evaluate(rpn: list[str]) -> tuple[int, set[str], bool] | None:
    """Terms, labels and whether all licenses are known; nothing where no license is named.

    An unknown license counts as the strictest and adds no label.
    """
    stack, labels, known = [], set(), True                          # items: terms, label while it may still take an exception, name
    for token in rpn:
        if token not in _PRECEDENCE:
            own = label(token)
            stack.append((own[1], own[0], token) if own else (len(TERMS) - 1, None, token))
            continue
        (b_terms, b_label, b_name), (a_terms, a_label, a_name) = stack.pop(), stack.pop()
        if token == "with":
            # An exception is no license: whether its name is known does not matter.
            stack.append((min(a_terms, 1) if a_terms == 2 else a_terms, a_label and f"{a_label}-with-{b_name}", a_name))
            continue
        for own, name in ((a_label, a_name), (b_label, b_name)):
            known = known and (own is not None or name is None)
            labels |= {own} if own else set()
        stack.append(((min if token == "or" else max)(a_terms, b_terms), None, None))
    if not stack:
        return None
    terms, own, name = stack[0]
    return terms, labels | ({own} if own else set()), known and (own is not None or name is None)


def _automata():
    """The automaton of phrases (between spaces) and that of tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES):
        found = (BASE[phrase], BASE_WEIGHT, True) if phrase in BASE else (*NOTICES[phrase], False)
        phrases.add_word(f" {phrase} ", (phrase.count(" ") + 1, *found))
    for tag in (*TAGS, *LOOSE_TAGS):
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def places(words: list[bytes], phrases) -> list[dict]:
    """``word, n_words, label, weight, base`` of every place where a phrase stands, by its first word.

    A notice that is part of a longer one at that place says nothing more; phrases of the contract all count.
    """
    # One sign for each byte: positions stay, and phrases are ASCII.
    line = b" " + b" ".join(words) + b" "
    out, at, passed = [], 0, -1
    for end, (n, name, weight, base) in phrases.iter(line.decode("latin-1")):
        passed += line.count(b" ", at, end + 1)
        at = end + 1
        out.append({"word": passed - n, "n_words": n, "label": name, "weight": weight, "base": base})
    kept, reach = [], -1
    for place in sorted(out, key=lambda p: (p["word"], -p["n_words"])):
        ends = place["word"] + place["n_words"]
        if place["base"] or ends > reach:
            kept.append(place)
        reach = max(reach, ends)
    return kept


def expressions(text: bytes, tags) -> list[dict]:
    """``at, tag, rpn, terms, labels`` of every tag that a license expression follows; ``at`` is its place in bytes."""
    lowered = text.lower()
    if b"licen" not in lowered:
        return []
    line, out, done = lowered.decode("latin-1"), [], 0
    for end, tag in tags.iter(line):
        if end < done:                                              # a loose tag inside a longer one
            continue
        rpn, done = postfix(line, end + 1)
        value = evaluate(rpn)
        # Behind loose tags stands prose as often: such an expression counts if all its licenses are known.
        if value and value[1] and (value[2] or tag in TAGS):
            out.append({"at": end + 1 - len(tag), "tag": tag, "rpn": " ".join(rpn), "terms": TERMS[value[0]], "labels": sorted(value[1])})
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, expressions, labels, score`` of every row of ``docs``.

    ``places`` are all places of notice phrases (first word from 0, number of words, label, weight, whether the phrase is
    one of ``BASE``), ``expressions`` all license expressions behind identifier tags (place in bytes, tag, reverse Polish
    form, terms, labels), ``labels`` the different labels of both, sorted.  ``score`` is 1 less the product of
    1 - weight over the labels, each with its surest evidence: 0 without any.

    Null and empty texts have no words and score 0; rows with null or repeated ids stand for themselves; an empty
    table gives an empty result.  Whole texts of any length are taken.  Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string()), ("weight", pa.float64()), ("base", pa.bool_())])
    expression = pa.struct([("at", pa.int64()), ("tag", pa.string()), ("rpn", pa.string()), ("terms", pa.string()),
                            ("labels", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = per_process("licenses", "automata", _automata)
        for batch in (part for whole in batches for part in portions(whole, "text")):
            out = {"n": [], "places": [], "expressions": [], "labels": [], "score": []}
            for t in batch.column("text"):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = normal(text)
                found, read = places(words, phrases), expressions(text, tags)
                weights = {}
                for p in found:
                    weights[p["label"]] = max(weights.get(p["label"], 0.0), p["weight"])
                for name in (name for e in read for name in e["labels"]):
                    weights[name] = TAG_WEIGHT
                missed = 1.0
                for name in sorted(weights):
                    missed *= 1.0 - weights[name]
                for c, v in zip(out.values(), (len(words), found, read, sorted(weights), 1.0 - missed)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["places"], pa.list_(place)),
                 pa.array(out["expressions"], pa.list_(expression)), pa.array(out["labels"], pa.list_(pa.string())),
                 pa.array(out["score"], pa.float64())], ["doc_id", "n_words", "places", "expressions", "labels", "score"])

    return src.mapInArrow(run, f"""doc_id {kind}, n_words bigint,
        places array<struct<word:bigint,n_words:int,label:string,weight:double,base:boolean>>,
        expressions array<struct<at:bigint,tag:string,rpn:string,terms:string,labels:array<string>>>,
        labels array<string>, score double""")


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: places of the base phrases, base labels and all labels of every document."""
    out = scan_licenses(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(places, p -> p.base)"))
    starts = F.transform("base", lambda p: p["word"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.transform("expressions", lambda e: e["rpn"]).alias("expressions"))
