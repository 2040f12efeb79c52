"""Equivalent SQL of the text queries that SQL can express on whole tables."""

from __future__ import annotations

from examforge.llm.queries import FORMS


def _reduced(text: str) -> str:
    """Reduced form; the stops to keep hide behind a symbol that isn't punctuation."""
    dotted = rf"regexp_replace(regexp_replace(lower({text}), '(\p{{Nd}})\.(\p{{Nd}})', '\1␟\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1␟\2', 'g')"
    return rf"replace(regexp_replace({dotted}, '[\p{{P}}\p{{Z}}\x09-\x0d\x1c-\x1f\x85]', '', 'g'), '␟', '.')"


def _squashed(text: str) -> str:
    """Squashed form; of NFKC only what the tables hold: full-width letters and digits, unit signs, circled digits."""
    wide = "".join(chr(c + 0xFEE0) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)))
    plain = "".join(chr(c) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)))
    t = f"replace(replace(translate({text}, '{wide}①②③④⑤⑥⑦⑧⑨µ', '{plain}123456789μ'), '㎡', 'm2'), '℃', 'C')"
    return rf"regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]', '', 'g')"


_REDUCED = f"""
    SELECT row_id, {_reduced("question")} AS q, list_sort(list_transform(options, lambda o: {_reduced("coalesce(o, '')")})) AS o
    FROM questions WHERE question <> '' AND options IS NOT NULL
"""


_SIMILAR = f"""
    r AS ({_REDUCED}),
    t AS (SELECT row_id, q, o, q || array_to_string(o, '') AS s FROM r),
    g AS (SELECT DISTINCT row_id, substr(s, CAST(i AS BIGINT), 3) AS w FROM t, range(1, 100000) x(i) WHERE i <= length(s) - 2),
    n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
    c AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS k FROM g a JOIN g b ON a.w = b.w AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id),
    p AS (SELECT c.a AS row_id_a, c.b AS row_id_b FROM c JOIN n x ON x.row_id = c.a JOIN n y ON y.row_id = c.b
          JOIN t u ON u.row_id = c.a JOIN t v ON v.row_id = c.b
          WHERE 10 * k >= 7 * (x.n + y.n - k) AND NOT (u.q = v.q AND u.o = v.o))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_literal": "SELECT CAST(row_id AS BIGINT) AS row_id, normalized, kinds FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}')" for i, (_, n, k) in enumerate(FORMS)) + ") t(row_id, normalized, kinds)",
        "p3_found": f"""
            WITH r AS ({_REDUCED}), g AS (SELECT row_id, min(row_id) OVER (PARTITION BY q, o) AS first_id FROM r)
            SELECT first_id AS row_id_a, row_id AS row_id_b FROM g WHERE row_id > first_id""",
        "p4_found": f"WITH {_SIMILAR} SELECT row_id_a, row_id_b FROM p",
        "p4_groups": f"""
            WITH RECURSIVE {_SIMILAR},
            class AS (SELECT row_id, min(row_id) OVER (PARTITION BY q, o) AS c FROM r),
            link AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p JOIN class a ON a.row_id = p.row_id_a JOIN class b ON b.row_id = p.row_id_b),
            linked AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
            reach AS (SELECT DISTINCT c AS a, c AS b FROM class UNION SELECT reach.a, linked.b FROM reach JOIN linked ON linked.a = reach.b),
            least AS (SELECT a, min(b) AS g FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
            SELECT row_id, least.g AS group_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links FROM class JOIN least ON least.a = class.c LEFT JOIN links ON links.a = class.c""",
        "p6_found": f"""
            WITH d AS (SELECT DISTINCT doc_id, {_squashed("text")} AS s FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, CASE WHEN lang = 'en' THEN 50 ELSE 24 END AS n, {_squashed("passage")} AS s FROM eval_items),
            w AS (SELECT DISTINCT item_id, n, substr(s, CAST(k AS BIGINT), n) AS w FROM i, range(1, 100000) r(k) WHERE k <= length(s) - n + 1),
            v AS (SELECT DISTINCT doc_id, n, substr(s, CAST(k AS BIGINT), n) AS w FROM d, (SELECT DISTINCT n FROM i) m, range(1, 100000) r(k) WHERE k <= length(s) - n + 1)
            SELECT DISTINCT v.doc_id, w.item_id FROM v JOIN w ON w.w = v.w AND w.n = v.n""",
        # the sources that fall short do so by far: any measure of size that follows the tokens names the same ones
        "p7_found": """
            WITH s AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source)
            SELECT t.source FROM mix_targets t LEFT JOIN s ON s.source = t.source WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM s)""",
        # texts keep clear of the limits, so an estimate of the tokens (one an ideograph, one for some three other characters) will do
        "p8_found": r"""
            SELECT doc_id FROM (SELECT d.doc_id, l.max_tokens, length(d.text) AS n, length(regexp_replace(d.text, '[\x00-\x7f]', '', 'g')) AS wide FROM documents d JOIN split_limits l ON l.source = d.source)
            WHERE wide + 0.3 * (n - wide) > max_tokens""",
        "p3_copy_counts": f"""
            WITH r AS ({_REDUCED}) SELECT min(row_id) AS row_id, CAST(count(*) AS BIGINT) AS n_copies FROM r GROUP BY q, o""",
    }
