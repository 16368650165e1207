"""SQL for DuckDB that gives the rows of queries which SQL can express."""

from __future__ import annotations

from shalegrid.llm.secret_links import ACCESS, ASSIGN, MIXED, ORDER, REACH, ROLES, WEAK


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folded(pattern: str) -> str:
    """The pattern with its group in either case spelt out, as this engine's own folding goes beyond ASCII."""
    begin = pattern.find("(?i:")
    if begin < 0:
        return pattern
    out, depth, at = ["(?:"], 1, begin + 4
    while depth:
        c = pattern[at]
        if pattern.startswith("(?:", at):
            out.append("(?:")
            depth, at = depth + 1, at + 3
            continue
        if c == "[":
            end = pattern.index("]", at)
            out.append(pattern[at : end + 1].replace("a-z", "a-zA-Z"))
            at = end + 1
            continue
        depth += (c == "(") - (c == ")")
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c)
        at += 1
    return pattern[:begin] + "".join(out) + pattern[at:]


def _spans(kind: str, pattern: str, wanted: str = "true") -> str:
    """Rows (doc_id, kind, s, e): places come from the lengths of matches and of the pieces between them."""
    p = _quoted(pattern)
    lens = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(h) AS e FROM (SELECT doc_id, hits[i] AS h, {lens.format("gaps[1:i]")} + {lens.format("hits[1:i-1]")} AS s
FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, string_split_regex(t, {p}) AS gaps FROM t WHERE regexp_matches(t, {p})))) WHERE {wanted}"""


def secret_links() -> str:
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{24,}"} | {k: p for k, (p, _) in WEAK.items()}
    patterns["opaque"] = "[A-Za-z0-9+/_-]{20,}"
    patterns = {k: _folded(p) for k, p in patterns.items()}
    wanted = {"assign": f"length(regexp_extract(h, {_quoted(_folded(ASSIGN))}, 1)) >= 6", "opaque": " AND ".join(f"regexp_matches(h, '{m}')" for m in MIXED)}
    parts = "\nUNION ALL ".join(_spans(k, p, wanted.get(k, "true")) for k, p in patterns.items())
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ORDER)) + " END"
    role = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items()) + " END"
    weak = ", ".join(f"'{k}'" for k in WEAK)
    text = "string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, n, e)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({parts}),
breaks AS ({_spans("break", chr(92) + "n[ " + chr(92) + "t]*" + chr(92) + "n" + chr(92) + "s*")}),
parts AS (SELECT f.*, {place} AS n, {role} AS role, (SELECT count(*) FROM breaks b WHERE b.doc_id = f.doc_id AND b.e <= f.s) AS scope FROM found f),
kept AS (SELECT doc_id, kind, n, s, e FROM parts WHERE kind NOT IN ({weak}) UNION ALL SELECT doc_id, kind, n, s, e FROM parts w WHERE kind IN ({weak}) AND EXISTS
(SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.scope = w.scope AND p.role <> w.role AND greatest(w.s - p.e, p.s - w.e) <= {REACH})),
base AS (SELECT doc_id, {text} AS x, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM kept WHERE kind NOT IN ({weak}) GROUP BY 1),
whole AS (SELECT doc_id, {text} AS x FROM kept GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base.x, '')) AS base_sha256, coalesce(whole.x, '') AS spans
FROM t LEFT JOIN base ON base.doc_id = t.doc_id LEFT JOIN whole ON whole.doc_id = t.doc_id"""


ORACLES = {"op8_secret_links": secret_links()}
