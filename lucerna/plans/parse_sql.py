"""The steps of response parsing in SQL, as common table expressions over rows `r`.

`r` has raw_response, strategy, type, choice_text, choice_label and answer (kept as `given`) beside any other columns, which are kept.
"""

from __future__ import annotations

from ..functions import vocabulary as V

TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
THINK = r"<\|?think\|?>.*?<\|?/?think\|?>"
OPEN = f"o AS (SELECT *, {TRIM(f'''regexp_replace(raw_response, '{THINK}', '', 'gs')''')} AS open FROM r)"
LABELS = "|".join(V.LABELS)
REFUSAL = "(?i)" + "|".join(V.REFUSALS).replace("'", "''")
START = rf"(?is)(?:^|\n)\s*\*{{0,3}}(?:{LABELS})\*{{0,3}}\s*:.*$"
CUT = f"c AS (SELECT *, CASE WHEN regexp_matches(open, '{START}') THEN ltrim(regexp_extract(open, '{START}', 0), chr(10)) ELSE open END AS cut FROM o)"
CLEAN = (
    "m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(cut, '```\\w*\\n?|```', '', 'g'), "
    f"'\\*{{1,3}}({LABELS})\\*{{1,3}}', '\\1', 'gi'), '`({LABELS})`', '\\1', 'gi'), '(?m)^#{{1,4}}\\s*', '', 'g') AS clean FROM c)"
)
STEPS = f"{OPEN}, {CUT}, {CLEAN}"


def pairs(strategy: str) -> str:
    """The parts of `clean` that begin with one of the strategy's labels, as label, chr(2), rest."""
    own = "|".join(V.STRATEGY_LABELS[strategy])
    return f"list_filter(string_split(regexp_replace(clean, '({own})\\s*:\\s*', chr(1) || '\\1' || chr(2), 'gi'), chr(1)), lambda x: contains(x, chr(2)))"


def last(parts: str, label: str) -> str:
    found = f"list_filter({parts}, lambda x: upper(split_part(x, chr(2), 1)) = '{label}')"
    return TRIM(f"split_part({found}[-1], chr(2), 2)")


def first_line(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {TRIM('x')}), lambda x: x <> '')[1]"


def stated(x: str, valid: str) -> list[str]:
    """The letters that the four patterns find, '' where one misses; x is stripped."""
    return [
        rf"upper(regexp_extract({x}, '^\s*\(?([A-Fa-f])\)?\s*$', 1))", rf"upper(regexp_extract({x}, '(?i)^\s*\(?([A-F])\)?[).:\s]+\S', 1))",
        rf"upper(regexp_extract({x}, '(?i)(?:answer|option|choice)\s+(?:is\s+)?[(\[]?([A-F])[)\]]?\b', 1))", rf"upper(regexp_extract({x}, '\b([A-Fa-f])\s*\.?\s*$', 1))",
    ]


def choice(x: str, valid: str, close: str | None = None) -> str:
    """A choice's letter, with the likeness step's one in `close` if there is that step; x is stripped."""
    letters = stated(x, valid)
    sole = f"list_distinct(list_filter(list_transform(string_split({x}, ''), lambda c: upper(c)), lambda c: list_contains({valid}, c)))"
    return "CASE " + " ".join(f"WHEN list_contains({valid}, {s}) THEN {s}" for s in letters) + (f" WHEN {close} IS NOT NULL THEN {close}" if close else "") + f" WHEN len({sole}) = 1 THEN {sole}[1] END"


def closest(rows: str, key: str, x: str) -> str:
    """From rows with a key, type, choice_text, choice_label and the stripped answer x to lc (key, close): the label of the choice most like the answer.

    lr holds the runs that answer and choice share, by diagonal. lw starts with the whole texts; each step takes the longest run that
    lies in a window, cut to it (the first one of both texts), and goes on with the windows before and behind it. Choices have less than
    200 signs here, so frequent signs need no rule of their own.
    """
    return f"""lp AS (SELECT {key}, k, lower({x}) AS a, lower(choice_text[k]) AS b FROM (SELECT *, unnest(range(1, len(choice_text) + 1)) AS k FROM {rows} WHERE type LIKE 'mcq%' AND {x} <> ''
    AND NOT ({' OR '.join(f'list_contains(choice_label, {s})' for s in stated(x, 'choice_label'))})) WHERE 2.0 * least(length({x}), length(choice_text[k])) / (length({x}) + length(choice_text[k])) >= {V.FUZZY_SHARE}),
lm AS (SELECT {key}, k, i, i - j AS d FROM (SELECT *, unnest(range(0, length(b))) AS j FROM (SELECT *, unnest(range(0, length(a))) AS i FROM lp)) WHERE substr(a, i + 1, 1) = substr(b, j + 1, 1)),
lr AS (SELECT {key}, k, d, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY {key}, k, d ORDER BY i) AS g FROM lm) GROUP BY {key}, k, d, g),
lw({key}, k, a0, a1, b0, b1, size) AS (SELECT {key}, k, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM lp
  UNION ALL SELECT {key}, k, CASE side WHEN 1 THEN a0 ELSE s + n END, CASE side WHEN 1 THEN s ELSE a1 END, CASE side WHEN 1 THEN b0 ELSE s - d + n END, CASE side WHEN 1 THEN s - d ELSE b1 END, CASE side WHEN 1 THEN n ELSE 0 END
  FROM (SELECT *, unnest([1, 2]) AS side FROM (SELECT *, row_number() OVER (PARTITION BY {key}, k, a0, a1, b0, b1 ORDER BY n DESC, s, s - d) AS best
    FROM (SELECT lw.{key}, lw.k, a0, a1, b0, b1, d, greatest(i, a0, b0 + d) AS s, least(i + lr.n, a1, b1 + d) - greatest(i, a0, b0 + d) AS n FROM lw JOIN lr ON lr.{key} = lw.{key} AND lr.k = lw.k) WHERE n > 0) WHERE best = 1)),
ls AS (SELECT {key}, k, 2.0 * m / (length(a) + length(b)) AS share FROM lp JOIN (SELECT {key}, k, sum(size) AS m FROM lw GROUP BY {key}, k) USING ({key}, k)),
lc AS (SELECT {key}, upper(arg_max(choice_label[k], (share, -k))) AS close FROM ls JOIN (SELECT {key}, choice_label FROM {rows}) USING ({key}) WHERE share >= {V.FUZZY_SHARE} GROUP BY {key})"""


def truth(x: str) -> str:
    """Yes or No, or null; x is stripped."""
    yes, no = (", ".join(f"'{w}'" for w, to in V.TRUTH_WORDS.items() if to == side) for side in ("Yes", "No"))
    low = f"lower({x})"
    word = f"regexp_extract({low}, '\\b({'|'.join(V.TRUTH_WORDS)})\\b', 1)"
    return f"CASE WHEN {low} IN ({yes}) THEN 'Yes' WHEN {low} IN ({no}) THEN 'No' WHEN {low} LIKE 'yes%' THEN 'Yes' WHEN {low} LIKE 'no%' THEN 'No' WHEN {word} IN ({yes}) THEN 'Yes' WHEN {word} IN ({no}) THEN 'No' END"


def open_answer(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%END' THEN {TRIM(f'left({x}, length({x}) - 3)')} ELSE {x} END"


def vote_text(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower({x}), '[.!?,;:]+$', ''), '\\s+', ' ', 'g'), '')"


def normal(x: str, otherwise: str, close: str | None = None) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN type LIKE 'mcq%' THEN {choice(x, 'choice_label', close)} WHEN type = 'true_or_false' THEN {truth(x)} ELSE {otherwise} END"


def citations(x: str) -> str:
    listed = f"flatten(list_transform(regexp_extract_all({x}, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: string_split(x, ',')))"
    others = [f"regexp_extract_all({x}, '{p}', 1)" for p in (r"\((\d+)\)", r"[Pp]assage\s+(\d+)", r"[Ss]ource\s+(\d+)")]
    every = f"list_concat(list_concat({listed}, {others[0]}), list_concat({others[1]}, {others[2]}))"
    return f"list_sort(list_distinct(list_filter(list_transform({every}, lambda x: TRY_CAST({TRIM('x')} AS INT)), lambda x: x BETWEEN 1 AND 10)))"


def _chinese(words: list[str], end: str, flags: str = "") -> str:
    dot = "." if flags else "[^\\n]"
    return TRIM(f"nullif(regexp_extract(clean, '{flags}(?:{'|'.join(words)})\\s*[:：]\\s*({dot}+?)(?:{end})', 1), '')")


ZH = "|".join([*V.CHINESE_ANSWER, *V.CHINESE_REASON, *V.CHINESE_CONFIDENCE, *V.CHINESE_OTHER])
FIELDS = {label: f"f{k}" for k, label in enumerate(V.LABELS)}
CHINESE = {
    "ANSWER": _chinese(V.CHINESE_ANSWER, "\\n|$"),
    "JUSTIFICATION": _chinese(V.CHINESE_REASON, f"(?:{ZH})\\s*[:：]|$", "(?s)"),
    "CONFIDENCE": _chinese(V.CHINESE_CONFIDENCE, "\\n|$"),
}
#: From `r` to `parsed`, which has the fields of a parsed response beside the columns of `r`.
PARSED = f"""{STEPS},
p AS (SELECT *, trim(coalesce(raw_response, ''), E' \\t\\n\\r') <> '' AS there, regexp_matches(open, '{REFUSAL}') AS refusal, regexp_matches(raw_response, '(?s){THINK}') AS removed,
  CASE strategy {' '.join(f"WHEN '{s}' THEN {pairs(s)}" for s in V.STRATEGIES)} END AS parts, regexp_replace(raw_response, '\\s+', '', 'g') AS dense FROM m),
z AS (SELECT *, len(list_filter(parts, lambda x: upper(split_part(x, chr(2), 1)) = 'ANSWER')) = 0 AND length(regexp_replace(dense, '[^一-鿿]', '', 'g')) > 0.3 * length(dense) AS zh FROM p),
f AS (SELECT *, {', '.join(f"CASE WHEN zh THEN {CHINESE.get(label, 'NULL')} ELSE {last('parts', label)} END AS {c}" for label, c in FIELDS.items())} FROM z),
g AS (SELECT *, nullif(f0, '') AS found, CASE WHEN there AND nullif(f0, '') IS NULL AND NOT refusal THEN {first_line('clean')} END AS fallback FROM f),
h AS (SELECT *, coalesce(found, fallback) AS reply FROM g),
n AS (SELECT *, {normal('reply', open_answer('reply'))} AS norm, type IN ('open-ended-qa', 'relation_extraction', 'filling') AS open_kind,
  array_to_string(list_filter([{', '.join(FIELDS.values())}], lambda x: x <> ''), ' ') AS said FROM h),
parsed AS (SELECT * EXCLUDE (refusal, answer), answer AS given, CASE WHEN refusal THEN coalesce(reply, 'REFUSED') ELSE reply END AS answer,
  CASE WHEN refusal THEN coalesce(nullif(norm, ''), 'REFUSED') WHEN norm IS NULL AND open_kind THEN reply ELSE norm END AS answer_normalized,
  f1 AS justification, f5 AS rationale, f2 AS key_reasoning, f3 AS uncertainty, nullif(lower({TRIM('f4')}), '') AS confidence,
  CASE WHEN there THEN {citations('said')} ELSE CAST([] AS INT[]) END AS citations,
  there AND (refusal OR norm IS NOT NULL OR (reply IS NOT NULL AND open_kind)) AS parse_success,
  CASE WHEN NOT there THEN ['empty_response'] WHEN found IS NOT NULL AND norm IS NULL AND type LIKE 'mcq%' THEN ['mc_normalization_failed'] WHEN found IS NULL AND fallback IS NOT NULL THEN ['answer_field_missing_used_fallback']
    WHEN found IS NULL AND NOT refusal THEN ['answer_field_missing'] ELSE CAST([] AS VARCHAR[]) END AS parse_errors,
  refusal, removed AS think_block_removed FROM n)"""

#: The same with the likeness step; needs WITH RECURSIVE.
PARSED_CLOSE = PARSED.replace("n AS (SELECT *, " + normal("reply", open_answer("reply")), closest("h", "question_id", "reply") + ",\nn AS (SELECT *, " + normal("reply", open_answer("reply"), "close")).replace("AS said FROM h)", "AS said FROM h LEFT JOIN lc USING (question_id))")


def votes(keys: str, quorum: int = V.QUORUM) -> str:
    """From `voted` (keys, sample_ix, valid, vote) to `outcome`, a row per question."""
    return f"""vc AS (SELECT {keys}, vote, count(*) AS k, min(sample_ix) AS first FROM voted WHERE vote IS NOT NULL GROUP BY {keys}, vote),
vw AS (SELECT {keys}, list(vote ORDER BY k DESC, first) AS answers, list(k ORDER BY k DESC, first) AS counts, sum(k)::BIGINT AS votes FROM vc GROUP BY {keys}),
outcome AS (SELECT {keys}, coalesce(answers[1], '') AS final_answer, coalesce(array_to_string(list_transform(list_zip(answers, counts), lambda x: x[1] || '=' || x[2]), ' | '), '') AS vote_counts, total_samples, valid_samples, coalesce(votes, 0) AS votes,
  coalesce(votes, 0) >= {quorum} AS sc_success, coalesce(round(counts[1] / votes, 6), 0.0) AS agreement_ratio, coalesce(votes >= {quorum} AND len(counts) > 1 AND counts[2] = counts[1], false) AS tie_broken
  FROM (SELECT {keys}, count(*) AS total_samples, count(*) FILTER (valid) AS valid_samples FROM voted GROUP BY {keys}) LEFT JOIN vw USING ({keys}))"""
