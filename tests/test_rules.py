"""The possessive forms find the same names and ends as the plain patterns."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom import rules

LINEAR = {}


def _collect(value, name):
    if isinstance(value, rules.Pattern):
        if value.linear:
            LINEAR[f"{name}:{value.text}"] = value
    elif isinstance(value, rules.Rule):
        _collect(value.pattern, value.rule_id)
    elif isinstance(value, dict):
        for key, item in value.items():
            _collect(item, f"{name}.{key}")
    elif isinstance(value, (tuple, list)):
        for item in value:
            _collect(item, name)


for _name, _value in vars(rules).items():
    _collect(_value, _name)

WORDS = [
    "public", "private", "static", "final", "virtual", "abstract", "sealed", "internal",
    "class", "interface", "function", "func", "int", "foo", "x", "get", "set", "throws",
    "password", "connectionString", " ", "  ", "\n", "\t", "(", ")", "{", "}", "=", ";", ":",
    "=>", "?", "?:", '"', '"a"', ",", "/", "(a)", "() {", "é",
]
TEXTS = st.lists(st.sampled_from(WORDS), max_size=40).map("".join)


def spans(regex, text, flags):
    return [(m.group(m.re.groups and 1), m.end()) for m in re.finditer(regex, text, flags)]


def test_there_are_linear_forms():
    assert len(LINEAR) > 15


@pytest.mark.parametrize("name", sorted(LINEAR))
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_linear_form(name, text):
    pattern = LINEAR[name]
    flags = re.IGNORECASE if pattern.ignore_case else 0
    if name.startswith("cs_"):  # only "is there a match in this line" is used
        for line in text.split("\n"):
            assert bool(re.search(pattern.text, line, flags)) == bool(
                re.search(pattern.linear, line, flags)
            )
    else:
        ours, plain = spans(pattern.linear, text, flags), spans(pattern.text, text, flags)
        if not re.compile(pattern.text).groups:
            ours, plain = [e for _, e in ours], [e for _, e in plain]
        assert ours == plain


NEEDLED = {
    f"{p.text}": p
    for group in (
        rules.ENDPOINT_PATTERNS, [c[1] for c in rules.CONFIG_PATTERNS],
        [h[0] for h in rules.HTTP_PATTERNS], rules.QUEUE_PATTERNS,
        *rules.COMMUNICATION_CATALOGUE.values(),
    )
    for p in group
}
for _rules in rules.SECURITY_RULES.values():
    for _rule in _rules:
        NEEDLED[_rule.pattern.text] = rules.Pattern(
            _rule.pattern.text, ignore_case=_rule.pattern.ignore_case,
            needles=(rules.SECURITY_NEEDLES[_rule.rule_id],),
        )


@pytest.mark.parametrize("text", sorted(NEEDLED))
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_every_match_holds_a_needle(text, data):
    pattern = NEEDLED[text]
    assert pattern.needles
    flags = re.IGNORECASE if pattern.ignore_case else 0
    match = data.draw(st.from_regex(re.compile(text, flags)))
    found = re.search(text, match, flags).group(0)
    low = found.translate(str.maketrans("ſıİK", "siik")).lower()
    assert any(needle in low for needle in pattern.needles)
