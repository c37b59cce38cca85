"""Cut function bodies out of brace languages, inside one row.

A body runs from the brace at the end of a function header to its matching
closing brace, whatever strings or comments contain.  Both the pairing and the
cutting stay in JVM array functions on the row that holds the text: no text is
shuffled and nothing is handed to Python.

* The text is cut after each brace, so brace number *i* ends chunk *i*.
* The depth after brace *i* is the running sum of +1/-1.  The level of an
  opening brace is its depth, that of a closing brace is its depth + 1.
  Ordered by (level, i), the element after an opening brace is its partner:
  depth moves by one, so a level is entered again only after it was left.
* A header is identified by the number of its opening brace: the count of
  braces in all text up to the end of the header.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.arrays import running_sum_sql
from codeloom.functions.text import java_regex
from codeloom.rules import Pattern


def brace_chunks(text: Column) -> Column:
    return F.split(text, r"(?<=[{}])", -1)


def brace_partners(chunks: str) -> Column:
    """For brace i (1-based) ``nr, close``: its closing partner, else null."""
    signs = f"""transform(slice({chunks}, 1, greatest(size({chunks}) - 1, 0)),
                          c -> if(endswith(c, '{{'), 1, -1))"""
    # (level, nr, sign): level first, then place in the text.
    numbered = f"""
      sort_array(transform(zip_with(sign, {running_sum_sql("sign")},
                                    (s, depth) -> named_struct('level', if(s = 1, depth, depth + 1), 'sign', s)),
                           (b, i) -> named_struct('level', b.level, 'nr', i + 1, 'sign', b.sign)))"""
    paired = """
      sort_array(transform(ordered, (b, i) -> named_struct(
        'nr', b.nr,
        'close', if(b.sign = 1 AND get(ordered, i + 1).level = b.level, get(ordered, i + 1).nr, NULL))))"""
    return F.expr(
        f"transform(transform(array({signs}), sign -> {numbered}), ordered -> {paired})[0]"
    )


def headers(text: str, header: Pattern, kind: str) -> Column:
    """``name, fn_type, nr`` of each header match; ``nr`` numbers its brace."""
    regex = java_regex(header)
    assert "'" not in regex
    counts = f"""
      zip_with(slice(split({text}, r'{regex}', -1), 1, size(matched)), matched,
               (a, b) -> regexp_count(a, '[{{}}]') + regexp_count(b, '[{{}}]'))"""
    return F.expr(
        f"""transform(array(regexp_extract_all({text}, r'{regex}', 0)), matched ->
              zip_with(matched, {running_sum_sql(counts)}, (m, nr) -> named_struct(
                'name', regexp_extract(m, r'{regex}', 1), 'fn_type', '{kind}', 'nr', nr)))[0]"""
    )


def bodies(found: str, chunks: str, partners: str, with_braces: str) -> Column:
    """``name, fn_type, open_brace, body`` of each header in ``found``.

    Without a partner the body is the opening brace and the next character or,
    where ``with_braces`` (an SQL condition) does not hold, empty.
    """
    close = f"{partners}[h.nr - 1].close"
    inner = f"array_join(slice({chunks}, h.nr + 1, {close} - h.nr - 1), '')"
    last = f"{chunks}[{close} - 1]"
    return F.expr(
        f"""transform({found}, h -> named_struct(
              'name', h.name, 'fn_type', h.fn_type, 'open_brace', h.nr,
              'body', CASE
                WHEN {with_braces} AND {close} IS NULL THEN concat('{{', left(get({chunks}, h.nr), 1))
                WHEN {with_braces} THEN concat('{{', {inner}, {last})
                WHEN {close} IS NULL THEN ''
                ELSE concat({inner}, left({last}, char_length({last}) - 1)) END))"""
    )
