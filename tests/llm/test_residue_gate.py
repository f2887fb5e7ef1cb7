"""Messages are ruled out by literals before the rules; with and without that the results are the same."""

import re
from re import _parser

import pytest

from strandframe.llm import residue as r

RULES = {"placeholder": r._PLACEHOLDER.pattern} | {k: "|".join(x.pattern for x in t) for k, t in r._TABLES.items() if k != "title"} | {"headings": r._HEADINGS}


def examples(parsed):
    """Texts in which every alternative of the pattern is taken at least once."""
    parts = []
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                parts.append([chr(arg)])
            case "ANY" | "NOT_LITERAL":
                parts.append(["z"])
            case "IN":
                some = [c for c in "a8 -%!?sdf([ß" if re.match(_set(arg), c)]
                parts.append([*(chr(v) for k, v in arg if str(k) == "LITERAL")][:6] if str(arg[0][0]) == "LITERAL" else some[:1])
            case "CATEGORY":
                parts.append(["a"])
            case "MAX_REPEAT" | "MIN_REPEAT":
                inner = examples(arg[2])
                parts.append([x * n for x in inner for n in sorted({arg[0], max(arg[0], 1)})])
            case "SUBPATTERN":
                parts.append(examples(arg[-1]))
            case "BRANCH":
                parts.append([e for x in arg[1] for e in examples(x)])
    base = [p[0] for p in parts]
    return ["".join(base)] + ["".join([*base[:i], e, *base[i + 1 :]]) for i, p in enumerate(parts) for e in p[1:]]


def _set(items):
    names = {"CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S"}
    body = "".join(names[str(v)] if str(k) == "CATEGORY" else re.escape(chr(v)) if str(k) == "LITERAL" else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}" if str(k) == "RANGE" else "^" for k, v in items)
    return f"[{body}]"


@pytest.mark.parametrize("name", RULES)
def test_every_alternative_passes_the_gate(name):
    texts = examples(_parser.parse(RULES[name], re.I))
    assert len(texts) > 3 and sum(r.rule(t) is not None for t in texts) >= len(texts) // 2
    for t in texts:
        for m in (t, t.upper(), f"Sample 7: {t} of the run", f'{t} "or" {t}'):
            assert r.gated(m) == r.rule(m), m


@pytest.mark.parametrize(
    ("message", "kind"),
    [("The requested document does not exist.", "error"), ("asdfgh qwerty", "filler"), ("This is a sample text.", "filler"), ("Results (to be done)", "filler"), ("[Überschrift hier]", "placeholder"), ("sed do sed do sed in the end", "filler"), ('Dear "Bob", the run is over.', "placeholder")],
)
def test_wordings_without_a_former_trigger(message, kind):
    assert r.classify(message) == kind
