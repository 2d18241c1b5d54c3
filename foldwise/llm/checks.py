"""DuckDB SQL that computes the rows of the queries SQL can express."""

from __future__ import annotations

from foldwise.llm.quality_rules import STOP_WORDS

ORACLES: dict[str, str] = {}

_WS = "[\\x20\\x09-\\x0D]"
_STOP = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))


def quality_sql(source: str) -> str:
    """CTEs that end in ``measured`` (a row of counts per row of ``source``) and ``judged`` (with the verdict)."""
    return f"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
measured AS (
  SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words, len(ls) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_exclamations
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         NOT (n_words < 20 OR n_repeat_words > 0.3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
              OR n_symbols > 0.2 * n_words OR n_exclamations > 0.3 * n_words OR n_stop_words < 0.05 * n_words
              OR n_dup_lines > 0.6 * n_lines) AS passes
  FROM measured)"""


ORACLES["op6_quality_rules"] = f"""WITH {quality_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept FROM judged"""


# ---- op11: the damage, the faults and one pass along the rows over the four marks of the grammar

# CRC-32 by its rule: the table of 256 entries, then one step per byte (the keys are ASCII).
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b)))"""


def crc32_sql(numbers: str) -> str:
    """CRC-32 of a list of bytes; ``tab`` is the table."""
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_FAR = "'~'"


def _plus(state: str, cost: str, letter: str) -> str:
    """A state is its cost in nine digits and then its audit, or '~' where it can't be reached."""
    return f"CASE WHEN {state} = {_FAR} THEN {_FAR} ELSE printf('%09d', CAST(left({state}, 9) AS BIGINT) + {cost}) || substr({state}, 10) || '{letter}' END"


def _insertions(source: str, keep: str) -> str:
    """The states of ``source`` after any insertions at this place."""
    m2 = f"least(m2, {_plus('m0', '2', 'I')}, {_plus('m1', '2', 'I')}, {_plus('m3', '2', 'I')})"
    m3 = f"least(m3, {_plus('m0', '4', 'II')}, {_plus('m1', '4', 'II')}, {_plus('m2', '2', 'I')})"
    return f"SELECT {keep}, m0, m1, {m2} AS m2, {m3} AS m3 FROM ({source}) before_insertions"


def _edited() -> str:
    def new(stay, *ways):
        reads = []
        for state, who in ways:
            reads.append(f"CASE WHEN fault IN ('blank', 'duplicate') OR i <> '{who}' THEN {_FAR} ELSE {_plus(state, 'cut', 'K')} END")
            if who != "s":
                reads.append(f"CASE WHEN fault IN ('blank', 'duplicate') THEN {_FAR} ELSE {_plus(state, '2 + cut', 'R')} END")
        return f"least({', '.join([_plus(stay, '3', 'D'), *reads])})"

    return (
        f"SELECT w.k, w.pos + 1 AS pos, {new('m0')} AS m0, {new('m1', ('m0', 's'))} AS m1, {new('m2', ('m0', 'u'), ('m1', 'u'), ('m3', 'u'))} AS m2, "
        f"{new('m3', ('m2', 'a'))} AS m3 FROM walk w JOIN faults f ON f.k = w.k AND f.pos = w.pos"
    )


ORACLES["op11_turn_repair"] = f"""WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') AS k,
                 list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)) AS bytes
          FROM conversations),
hit AS (SELECT conv_id, k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql('bytes')} % 20 AS h FROM keyed, crc_table),
damaged AS (SELECT k, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit)),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos,
                  regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare, substr(role, 1, 1) AS i FROM damaged),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                  CASE WHEN bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
                  lag(i) OVER (PARTITION BY k ORDER BY pos) AS before
           FROM (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) AS nth FROM placed)),
walk AS (
  {_insertions(f"SELECT DISTINCT k, 0 AS pos, '000000000' AS m0, {_FAR} AS m1, {_FAR} AS m2, {_FAR} AS m3 FROM keyed", "k, CAST(pos AS BIGINT) AS pos")}
  UNION ALL
  {_insertions(_edited(), "k, pos")}),
ended AS (SELECT k, least(m0, m3) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1),
audited AS (SELECT k, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended),
letters AS (SELECT k, audit, n, substr(audit, n, 1) AS e, length(replace(left(audit, n - 1), 'I', '')) AS pos,
                   length(replace(left(audit, n), 'D', '')) - 1 AS spot, length(replace(audit, 'D', '')) % 2 AS odd
            FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS n FROM audited)),
said AS (SELECT l.k, l.n, CASE WHEN e = 'K' THEN f.role WHEN (spot - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
         FROM letters l LEFT JOIN faults f ON f.k = l.k AND f.pos = l.pos WHERE e <> 'D'),
digest AS (SELECT k, sha256(string_agg(line, chr(10) ORDER BY n)) AS d FROM said GROUP BY k),
counted AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY k)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, a.cost, a.audit,
       coalesce(g.d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM keyed) c JOIN audited a ON a.k = c.k LEFT JOIN counted n ON n.k = c.k LEFT JOIN digest g ON g.k = c.k"""
