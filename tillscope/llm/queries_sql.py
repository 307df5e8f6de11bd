"""DuckDB SQL that states the queries of this subpackage a second time."""

from __future__ import annotations

from tillscope.llm import hard_negatives, secrets
from tillscope.llm.mixing import MOST_REPEATS, SHARE_PERCENT, WEIGHTS
from tillscope.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, Rule

_WORD = r"[^\x20\x09-\x0D]+"

_PERSPECTIVES = """
WITH said AS (
    SELECT conv_id, turn, COALESCE(role, 'unknown') AS speaker,
           replace(COALESCE(text, ''), '<|', '< |') AS body
    FROM conversations
),
people AS (
    SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM said WHERE speaker <> 'system'
),
seen AS (
    SELECT said.*, perspective,
           CASE WHEN speaker = 'system' THEN 'system'
                WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
    FROM said JOIN people ON conv_id IS NOT DISTINCT FROM conv
),
headed AS (
    SELECT *, '<|im_start|>' || chat_role
           || CASE WHEN chat_role = 'user'
                   THEN ' name=' || replace(replace(speaker, '<|', '< |'), chr(10), ' ')
                   ELSE '' END
           || chr(10) AS head
    FROM seen
)
SELECT conv_id, perspective, turn, speaker, chat_role,
       head || body || '<|im_end|>' || chr(10) AS segment,
       CAST(CASE WHEN chat_role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT)
           AS mask_start,
       CAST(CASE WHEN chat_role = 'assistant' THEN length(head || body || '<|im_end|>')
                 ELSE 0 END AS BIGINT) AS mask_end
FROM headed"""

_MIX = f"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(len(regexp_extract_all(COALESCE(text, ''), '{_WORD}')) AS BIGINT) AS size
    FROM documents
),
sources AS (
    SELECT source, sum(size) AS source_size,
           list_extract({list(WEIGHTS)},
               1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) AS weight
    FROM sized GROUP BY source
),
ordered AS (
    SELECT *, {MOST_REPEATS} * source_size AS cap,
           row_number() OVER (ORDER BY {MOST_REPEATS} * source_size / weight, source NULLS LAST)
               AS place
    FROM sources
),
levels AS (
    SELECT a.source, a.source_size, a.weight, a.cap, a.place,
           CAST((SELECT sum(source_size) FROM sources) * {SHARE_PERCENT}
                - 100 * COALESCE(sum(b.cap) FILTER (b.place < a.place), 0) AS DOUBLE)
           / CAST(100 * sum(b.weight) FILTER (b.place >= a.place) AS DOUBLE) AS level
    FROM ordered a CROSS JOIN ordered b
    GROUP BY ALL
),
water AS (
    SELECT arg_min(level, place) AS water FROM levels WHERE level * weight < cap
),
targets AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size,
           CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE water * weight END
               AS target
    FROM levels CROSS JOIN water
),
rated AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13)
                AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS chance
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
),
counted AS (
    SELECT *, CAST(floor(rate) AS INTEGER)
              + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CAST(copies AS INTEGER) AS copies
FROM counted"""


def _holds(rule: Rule) -> str:
    sides = [f"{rule.measure} >= {rule.least}"] if rule.least is not None else []
    sides += [f"{rule.measure} <= {rule.most}"] if rule.most is not None else []
    return " AND ".join(sides)


_BASE = " AND ".join(_holds(rule) for rule in RULES if rule.name in BASE_RULES)
_ALL = " AND ".join(map(_holds, RULES))
_STOPS = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS.split())))

_QUALITY = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, COALESCE(text, '') AS t FROM documents
),
split AS (
    SELECT row_id, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
    FROM texts
),
windows AS (
    SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
    FROM (SELECT row_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM split)
),
again AS (
    SELECT row_id, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1
),
covered AS (
    SELECT row_id, count(DISTINCT i + k) AS n
    FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
    GROUP BY row_id
),
counted AS (
    SELECT doc_id,
           CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           COALESCE(n, 0) AS n_repeat_words,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
           CAST(length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS BIGINT) AS n_capitals
    FROM split LEFT JOIN covered USING (row_id)
)
SELECT *, NOT ({_BASE}) AS base_failed, ({_ALL}) AS kept FROM counted"""

_NAMES = ", ".join(f"'{kind.name}'" for kind in secrets.KINDS)


def _finds(number: int, kind: secrets.Kind) -> str:
    pattern = kind.pattern.replace("'", "''")
    return f"""
    SELECT row_id, owner, repository, {number} AS kind, unnest(range(1, len(whole) + 1)) AS place,
           unnest(gaps[:len(whole)]) AS gap, unnest(whole) AS found, unnest(part) AS value,
           {kind.least} AS least
    FROM (SELECT row_id, owner, repository, string_split_regex(t, '{pattern}') AS gaps,
                 regexp_extract_all(t, '{pattern}') AS whole,
                 regexp_extract_all(t, '{pattern}', {kind.group}) AS part
          FROM texts)"""


_FOUND = " UNION ALL ".join(_finds(n, kind) for n, kind in enumerate(secrets.KINDS))
_BASES = len(secrets.BASE_KINDS)

_SECRETS = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, COALESCE(text, '') AS t,
           source AS owner, text AS repository
    FROM documents
),
found AS ({_FOUND}),
placed AS (
    SELECT *, sum(length(gap) + length(found)) OVER (
               PARTITION BY row_id, kind ORDER BY place) AS stop
    FROM found
),
serious AS (
    SELECT *, stop - length(found) AS start FROM placed
    WHERE length(value) >= least
      AND (kind < {_BASES}
           OR (length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secrets._LEAST_DIGITS}
               AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= {secrets._LEAST_LETTERS}
               AND len(list_distinct(string_split(value, ''))) >= {secrets._LEAST_DIFFERENT}))
),
holders AS (
    SELECT value, count(DISTINCT COALESCE('+' || owner, '')) <= {secrets.MOST_OWNERS}
           AND count(DISTINCT (COALESCE('+' || owner, ''), COALESCE('+' || repository, '')))
               <= {secrets.MOST_REPOSITORIES} AS owned
    FROM serious GROUP BY value
),
judged AS (SELECT s.*, owned FROM serious s JOIN holders h ON s.value = h.value),
reported AS (
    SELECT * FROM judged WHERE kind < {_BASES}
    UNION ALL
    SELECT a.* FROM judged a
    WHERE kind >= {_BASES} AND owned AND NOT EXISTS (
        SELECT 1 FROM judged b WHERE b.row_id = a.row_id AND b.kind < {_BASES}
           AND b.start < a.stop AND b.stop > a.start)
),
listed AS (
    SELECT row_id, kind, owned,
           [{_NAMES}][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)
               AS span, start
    FROM reported
),
per_row AS (
    SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {_BASES}) AS base,
           string_agg(span, ',' ORDER BY start, kind) AS spans,
           count(*) FILTER (owned) AS n_owned, count(*) FILTER (NOT owned) AS n_copied
    FROM listed GROUP BY row_id
)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access,
       COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256,
       COALESCE(spans, '') AS spans, COALESCE(n_owned, 0) AS n_owned,
       COALESCE(n_copied, 0) AS n_copied
FROM texts LEFT JOIN per_row USING (row_id)"""

_S = hard_negatives.Settings()
_NEGATIVES = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor({_S.scale} * CAST(c AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT)
               AS score
    FROM rows a JOIN rows r ON r.vec_id <> a.vec_id
    WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)
            <= {_S.positives}
)
SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
       CAST(row_number() OVER (
           PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE {_S.least_percent} * positive_score <= 100 * score
  AND 100 * score <= {_S.most_percent} * positive_score
QUALIFY rank <= {_S.negatives}"""

SQL: dict[str, str] = {
    "op3_perspective_rotation": _PERSPECTIVES,
    "op9_mix_sources": _MIX,
    "op10_quality_rules": _QUALITY,
    "op12_owned_secrets": _SECRETS,
    "op13_residue_negatives": _NEGATIVES,
}
