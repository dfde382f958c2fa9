"""License scans: brute-force places, the expression parser against a recursive one, edge rows."""
import random
import re

import pytest

from montevar.llm import licenses
from tests.llm.helpers import documents, folder

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_places(text):
    words = WORD.findall(lowered(text))
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


def test_contract_columns_equal_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    bits = ["under", "the", "mit", "license", "MIT License", "Apache License, Version 2.0", "apache", "version", "2", "cc", "by", "nc", "CC BY-NC",
            "under the MIT License", "é", "\n", ".", "-", "x2", "K", "SPDX-License-Identifier: MIT OR GPL-2.0-only\n", "under theMIT license"]
    rows = [(k, "".join(rnd.choice(bits) + rnd.choice([" ", " ", "\n", "-", ""]) for _ in range(rnd.randrange(60)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "..."), (None, "cc by nc"), (7, "cc-by-nc"), (7, "cc-by-nc"),
             (903, "x " * 30_000 + "cc by nc cc by nc")]
    sf = folder(spark, tmp_path, documents=documents(spark, rows).repartition(3))
    out = licenses.op13(spark, sf).collect()
    got, want = [], []
    for r in out:
        got.append(tuple(map(str, (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels) and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    for k, text in rows:
        n, found = base_places(text)
        starts = [i for i, _ in found]
        want.append(tuple(map(str, (k, n, len(found), min(starts, default=None), max(starts, default=None),
                                    ",".join(sorted({x for _, x in found}))))))
    assert sorted(got) == sorted(want)
    assert licenses.op13(spark, folder(spark, tmp_path, documents=documents(spark, []).coalesce(1))).count() == 0


def recursive(tokens):
    """Terms of an expression by precedence climbing."""
    def primary():
        token = tokens.pop(0)
        if token == "(":
            value = choice()
            tokens.pop(0)
        else:
            own = licenses.label(token)
            value = own[1] if own else 3
        while tokens and tokens[0] == "with":
            del tokens[:2]
            value = 1 if value == 2 else value
        return value

    def both():
        value = primary()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            value = max(value, primary())
        return value

    def choice():
        value = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            value = min(value, both())
        return value

    return choice()


def grown(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        leaf = [rnd.choice(["mit", "apache-2.0", "gpl-3.0-or-later", "mpl-2.0", "cc-by-nc-4.0", "made-up-1.0"])]
        return leaf + (["with", "classpath-exception-2.0"] if rnd.random() < 0.2 else [])
    inner = grown(rnd, depth - 1) + [rnd.choice(["and", "or"])] + grown(rnd, depth - 1)
    return ["(", *inner, ")"] if rnd.random() < 0.5 else inner


def test_parser_equals_a_recursive_one():
    rnd = random.Random(4)
    for _ in range(2000):
        tokens = grown(rnd, 4)
        rpn, end = licenses.postfix(text := " ".join(tokens))
        assert end == len(text)
        terms, labels, known = licenses.evaluate(rpn)
        assert terms == recursive(list(tokens))
        assert known == ("made-up-1.0" not in tokens)
        families = {licenses.label(t)[0] for t in tokens if licenses.label(t)}
        assert {x.split("-with-")[0] for x in labels} == families


@pytest.mark.parametrize("text, rpn", [
    ("mit and", "mit"), ("((mit", "mit"), ("mit) or x", "mit"), ("or mit", ""), ("mit apache", "mit"), ("()", ""),
    ("mit or (", "mit"), ("mit or (apache-2.0) and gpl-3.0+", "mit apache-2.0 gpl-3.0+ and or"), ("mit with (x)", "mit"),
    ("mit. Then", "mit"), ("(mit or isc) and zlib", "mit isc or zlib and"), ("", "")])
def test_broken_expressions_end_where_they_break(text, rpn):
    out, _ = licenses.postfix(text.lower())
    assert " ".join(out) == rpn
    licenses.evaluate(out)


def test_tags_and_notices():
    phrases, tags = licenses._automata()
    read = licenses.expressions(b"# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)\nlicense: our terms\nLicense: ISC\n", tags)
    assert [(e["terms"], e["labels"]) for e in read] == [("permissive", ["gpl-2-with-classpath-exception-2.0", "mit"]), ("permissive", ["isc"])]
    found = licenses.places(licenses.normal(b"licensed under the GNU General Public License, version 3."), phrases)
    assert [(p["word"], p["label"]) for p in found] == [(3, "gpl-3")]


def test_long_expressions_take_linear_time():
    rpn, _ = licenses.postfix("(" * 20_000 + "mit" + " or mit)" * 20_000)
    assert licenses.evaluate(rpn)[1] == {"mit"}
