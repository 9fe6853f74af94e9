"""Pieces of SQL for the queries' counterparts: text functions, fingerprints and
stems, each written from its definition rather than from the DataFrame code."""

from __future__ import annotations

from .functions.lexicon import COMMON_WORDS, STOP_WORDS, TAXONOMY
from .functions.porter import STEP2, STEP3, STEP4


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOP = _list(STOP_WORDS)


def query_tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))"


def tokens(t: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({t}), '[a-z][a-z0-9\-]*[a-z0-9]|[a-z]'), lambda x: length(x) BETWEEN 2 AND 30 AND x NOT IN ({STOP}))"


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def strip_markdown(t: str) -> str:
    for pattern, new in (
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"\*{1,3}|_{1,3}", ""),
        ("`{1,3}", ""),
        (r"(?m)^\s*[-*+]\s", ""),
        (r"(?m)^\s*\d+\.\s", ""),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return t


def clean(t: str) -> str:
    t = rf"regexp_replace(regexp_replace({t}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({t}, '(?m)[ \t]+$', '', 'g')")


def flat(t: str) -> str:
    return strip(rf"regexp_replace({t}, '\s+', ' ', 'g')")


def sentences(t: str) -> str:
    return rf"list_filter(string_split(regexp_replace({flat(t)}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"


def truncate(t: str, most: int) -> str:
    head = f"left({t}, {most})"
    last = f"({most} - strpos(reverse({head}), ' '))"
    return rf"""CASE WHEN length({t}) <= {most} THEN {t} ELSE regexp_replace(CASE WHEN strpos(reverse({head}), ' ') > 0 AND {last} > {most // 2} THEN left({head}, {last}) ELSE {head} END, '[ .,;:!?]+$', '') || '...' END"""


CORPUS = rf"""corpus AS (SELECT 'doc-' || doc_id AS slug, doc_id, coalesce(text, '') AS text, lang, source, coalesce(left({sentences('text')}[1], 60), '') AS title FROM documents)"""

# -- fingerprints of a table ``corpus`` (slug, title, text) --------------------------

TF = f"""tk AS (SELECT slug, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT slug, {tokens('text')} AS t FROM corpus)),
tfs AS (SELECT slug, token, count(*) AS n, min(pos) AS first FROM tk GROUP BY ALL),
tfa AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * n / max(n) OVER (PARTITION BY slug) AS tf FROM tfs)"""

KEYWORDS = rf"""bo AS (SELECT slug, list_distinct({tokens('title')}) AS tt, list_distinct({tokens(r"regexp_split_to_array(text, '\n\s*\n')[1]")}) AS fp,
  list_distinct({tokens(r"array_to_string(regexp_extract_all(text, '(?m)^#{1,6}\s+(.+)$', 1), chr(10))")}) AS hd FROM corpus),
ks AS (SELECT slug, token, first, round(tf * (CASE WHEN token IN ({_list(COMMON_WORDS)}) THEN 1.0::DOUBLE WHEN length(token) <= 3 THEN 2.45::DOUBLE ELSE 3.5::DOUBLE END)
  * (CASE WHEN list_contains(tt, token) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN list_contains(fp, token) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN list_contains(hd, token) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM tfa JOIN bo USING (slug)),
kf AS (SELECT slug, token, score, row_number() OVER (PARTITION BY slug ORDER BY score DESC, first) AS rank FROM ks QUALIFY rank <= 10)"""

_TAX = ", ".join(f"('{c}', '{w}')" for c, ws in TAXONOMY.items() for w in ws)
CATEGORIES = f"""tax AS (SELECT * FROM (VALUES {_TAX}) t(category, word)),
cs AS (SELECT slug, category, sum(CASE WHEN word = token THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM kf JOIN tax ON contains(word, token) OR contains(token, word) GROUP BY ALL HAVING score >= 1),
ct AS (SELECT slug, category, score, row_number() OVER (PARTITION BY slug ORDER BY score DESC, category) AS rank FROM cs QUALIFY rank <= 5)"""

BIGRAMS = f"""bt AS (SELECT slug, {tokens('text')} AS t FROM corpus),
bp AS (SELECT slug, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM bt),
bg AS (SELECT slug, bigram, count(*) AS n FROM bp GROUP BY ALL HAVING count(*) >= 2)"""

#: Letters beyond ASCII are word characters, as the patterns' boundaries see them.
CONCEPTS = rf"""caps0 AS (SELECT slug, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){{0,2}})\b', 1)) AS concept FROM corpus),
caps AS (SELECT slug, concept, count(*)::DOUBLE AS w FROM caps0 GROUP BY ALL HAVING regexp_matches(concept, '\s') OR (count(*) >= 2 AND lower(concept) NOT IN ({STOP}) AND length(concept) > 3)),
hd0 AS (SELECT slug, trim(regexp_replace(unnest(regexp_extract_all(text, '(?m)^#{{1,6}}\s+(.+)$', 1)), '[^a-zA-Z0-9 \-]', '', 'g')) AS h FROM corpus),
hd1 AS (SELECT slug, h, {words('h')} AS ws FROM hd0 WHERE h <> ''),
heads AS (SELECT slug, h AS concept, 3.0::DOUBLE AS w FROM hd1 WHERE len(ws) <= 3
  UNION ALL SELECT slug, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))), 2.5 FROM hd1 WHERE len(ws) > 3
  UNION ALL SELECT slug, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))), 2.5 FROM hd1 WHERE len(ws) > 3),
em0 AS (SELECT slug, {strip("regexp_replace(m, '^[*_]{1,3}|[*_]{1,3}$', '', 'g')")} AS concept FROM (SELECT slug, unnest(regexp_extract_all(text, '\*{{1,3}}([^*\n]+)\*{{1,3}}|_{{1,3}}([^_\n]+)_{{1,3}}', 0)) AS m FROM corpus)),
ev AS (SELECT slug, concept, w FROM caps UNION ALL SELECT * FROM heads
  UNION ALL SELECT slug, concept, 2.0 FROM em0 WHERE len({words('concept')}) BETWEEN 1 AND 3 AND length(concept) <= 50
  UNION ALL SELECT slug, bigram, n * 1.5 FROM bg
  UNION ALL SELECT slug, concept, 5.0 FROM (SELECT slug, trim(regexp_replace(title, '[^a-zA-Z0-9 \-]', '', 'g')) AS concept FROM corpus) WHERE len({words('concept')}) BETWEEN 1 AND 3),
cn AS (SELECT slug, concept, sum(w)::DOUBLE AS score FROM ev GROUP BY ALL HAVING length(concept) > 1 AND NOT regexp_matches(replace(replace(concept, ' ', ''), '-', ''), '^[0-9]+$') AND lower(concept) NOT IN ({STOP})),
cc AS (SELECT slug, concept, score, row_number() OVER (PARTITION BY slug ORDER BY score DESC, concept) AS rank FROM cn QUALIFY rank <= 10)"""


def synopsis(most: int = 200, source: str = "corpus", out: str = "syn") -> str:
    """(slug, synopsis) of ``source`` (slug, title, text)."""
    n = "length(s)"
    size = f"CASE WHEN {n} BETWEEN 50 AND 150 THEN 1.0::DOUBLE WHEN {n} < 50 THEN {n} / 50.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1.0::DOUBLE - ({n} - 150) / 300.0::DOUBLE) END"
    place = "CASE WHEN i = 1 THEN 1.5::DOUBLE WHEN i <= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"
    overlap = f"len(list_intersect(list_distinct({tokens('s')}), tt))"
    return rf"""{out}p AS (SELECT slug, {strip_markdown('text')} AS p, list_distinct({tokens('title')}) AS tt FROM {source}),
{out}s AS (SELECT slug, tt, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT slug, tt, {sentences(f"array_to_string({words('p')}[1:500], ' ')")} AS ss FROM {out}p)),
{out}b AS (SELECT slug, s FROM (SELECT slug, s, i, ({size}) * ({place}) * (1.0::DOUBLE + {overlap} * 2.0::DOUBLE) AS score FROM {out}s) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY score DESC, i) = 1),
{out}f AS (SELECT slug, CASE WHEN len({words('p')}) < 50 THEN {flat('p')} ELSE coalesce(s, {flat('p')}) END AS t FROM {out}p LEFT JOIN {out}b USING (slug)),
{out} AS (SELECT slug, {truncate('t', most)} AS synopsis FROM {out}f)"""


DESCRIBED = f"""dk AS (SELECT slug, list(token ORDER BY rank) AS fingerprint FROM kf GROUP BY 1),
dg AS (SELECT slug, list(category ORDER BY rank) AS categories FROM ct GROUP BY 1),
dn AS (SELECT slug, list(concept ORDER BY rank) AS found FROM cc GROUP BY 1),
described AS (SELECT c.*, coalesce(fingerprint, []) AS fingerprint, coalesce(categories, ['general']) AS categories, synopsis AS summary,
  (coalesce(found, []) || list_filter(coalesce(fingerprint, []), lambda w: NOT list_contains(list_transform(coalesce(found, []), lambda f: lower(f)), w)))[1:greatest(len(coalesce(found, [])), 3)] AS concepts
  FROM corpus c LEFT JOIN dk USING (slug) LEFT JOIN dg USING (slug) LEFT JOIN dn USING (slug) JOIN syn USING (slug))"""

FINGERPRINTS = ",\n".join((TF, KEYWORDS, CATEGORIES, BIGRAMS, CONCEPTS, synopsis(), DESCRIBED))


# -- stems ------------------------------------------------------------------------


def stems(source: str, column: str, out: str = "stems") -> str:
    """(term, stem) of the distinct terms of a table, by Porter's algorithm:
    letters only, y at the start is a consonant, measures as patterns."""
    one, vowel = "[^aeiou]", "[aeiouy]"
    c, v = one + "[^aeiouy]*", vowel + "[aeiou]*"
    some, exactly, more, voiced = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}", f"^({c})?{vowel}"
    short = f"^{c}{vowel}[^aeiouwxy]$"
    double = "(" + "|".join(x + x for x in "bcdfghjkmnpqrtvwx") + ")$"
    cut = lambda n: f"left(w, length(w) - {n})"

    def suffixes(table: dict[str, str], condition: str) -> str:
        cases = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches({cut(len(s))}, '{condition}') THEN {cut(len(s))} || '{table[s]}' ELSE w END" for s in sorted(table, key=len, reverse=True)]
        return "CASE " + " ".join(cases) + " ELSE w END"

    step4 = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches({cut(len(s))}, '{more}')" + (f" AND regexp_matches({cut(len(s))}, '[st]$')" if s == "ion" else "") + f" THEN {cut(len(s))} ELSE w END" for s in sorted(STEP4, key=len, reverse=True)]
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        # 1b is two steps: the suffix goes, with a mark where the rest is to be mended
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, '{some}') THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') THEN CASE WHEN regexp_matches({cut(2)}, '{voiced}') THEN {cut(2)} || '+' ELSE w END WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '{voiced}') THEN {cut(3)} || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches({cut(1)}, '(at|bl|iz)$') THEN {cut(1)} || 'e' WHEN regexp_matches({cut(1)}, '{double}') THEN {cut(2)} WHEN regexp_matches({cut(1)}, '{short}') THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND regexp_matches({cut(1)}, '{voiced}') THEN {cut(1)} || 'i' ELSE w END",
        suffixes(STEP2, some),
        suffixes(STEP3, some),
        "CASE " + " ".join(step4) + " ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, '{more}') OR (regexp_matches({cut(1)}, '{exactly}') AND NOT regexp_matches({cut(1)}, '{short}'))) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{more}') THEN {cut(1)} ELSE w END",
    ]
    parts = [f"{out}0 AS (SELECT DISTINCT {column} AS term, CASE WHEN {column}[1] = 'y' THEN 'Y' || {column}[2:] ELSE {column} END AS w FROM {source})"]
    for k, step in enumerate(steps):
        parts.append(f"{out}{k + 1} AS (SELECT term, CASE WHEN length(term) < 3 OR NOT regexp_matches(term, '^[a-z]+$') THEN w ELSE {step} END AS w FROM {out}{k})")
    parts.append(f"{out} AS (SELECT term, CASE WHEN w[1] = 'Y' AND term[1] = 'y' THEN 'y' || w[2:] ELSE w END AS stem FROM {out}{len(steps)})")
    return ",\n".join(parts)


def bm25(source: str, fields: str, out: str = "bm25", stemmed: bool = False) -> str:
    """(query_id, slug, score, rank): BM25 of benchmark's items over the tokens of
    ``fields``, an expression on ``source``."""
    t = lambda x: rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"
    asked = r"list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
    idf = "ln((st.n - df + 0.5) / (df + 0.5))"
    parts = [
        f"{out}t AS (SELECT slug, {t(fields)} AS t FROM {source})",
        f"{out}r AS (SELECT slug, len(t) AS dl, unnest(t) AS term FROM {out}t)",
        f"{out}w AS (SELECT item_id AS query_id, unnest({t(f'array_to_string({asked}, chr(32))')}) AS term FROM benchmark)",
    ]
    raw, words_ = f"{out}r", f"{out}w"
    if stemmed:
        parts.append(stems(f"(SELECT term FROM {out}r UNION SELECT term FROM {out}w)", "term", f"{out}s"))
        parts += [f"{out}rs AS (SELECT slug, dl, stem AS term FROM {out}r JOIN {out}s USING (term))", f"{out}ws AS (SELECT query_id, stem AS term FROM {out}w JOIN {out}s USING (term))"]
        raw, words_ = f"{out}rs", f"{out}ws"
    parts += [
        f"{out}p AS (SELECT term, slug, dl, count(*) AS tf FROM {raw} GROUP BY ALL)",
        f"{out}a AS (SELECT count(*) AS n, avg(len(t)) AS a FROM {out}t)",
        f"{out}d AS (SELECT term, count(*) AS df FROM {out}p GROUP BY 1)",
        f"{out}q AS (SELECT query_id, term, count(*) AS n FROM {words_} GROUP BY ALL)",
        f"""{out}h AS (SELECT query_id, slug, round(sum(q.n * (CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / st.a))), 6) AS score
  FROM {out}q q JOIN {out}p USING (term) JOIN {out}d USING (term) CROSS JOIN {out}a st GROUP BY ALL)""",
        f"{out} AS (SELECT query_id, slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM {out}h QUALIFY rank <= 10)",
    ]
    return ",\n".join(parts)


# -- slugs and sections --------------------------------------------------------------


def cut_at_hyphen(s: str, most: int) -> str:
    tail = f"strpos(reverse(left({s}, {most})), '-')"
    return f"CASE WHEN length({s}) <= {most} THEN {s} WHEN {tail} > 0 AND {most} - {tail} > 0 THEN left({s}, {most} - {tail}) ELSE left({s}, {most}) END"


def slug_base(t: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip(f'lower({t})')}, '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"


def heading_base(t: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(regexp_replace({t}, '^#+\s*', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def joined(*parts: str) -> str:
    """Parts that aren't empty, with blank lines between."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), chr(10) || chr(10))"


def sections(source: str, threshold: int, least: int) -> str:
    """CTEs of the sections of ``source`` (slug, text): ``secs`` (slug, preamble,
    ss) of documents that are split, and ``kids`` (slug, parent, section_index,
    title, body)."""

    def at_level(mark: str, name: str) -> str:
        first = "split_part(p, chr(10), 1)"
        each = f"{{'heading': {strip(first)}, 'body': {strip(f'substr(p, length({first}) + 1)')}}}"
        return rf"""{name} AS (SELECT slug, {strip('pp[1]')} AS pre, list_transform(pp[2:], lambda p: {each}) AS ss FROM (SELECT slug, string_split(regexp_replace(text, '(?m)^({mark}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS pp FROM {source}))"""

    carried = f"CASE WHEN a.c THEN {strip(joined('a.h', 'a.b', 'x.b'))} ELSE x.b END"
    short = f"len({words(f'''x.h || ' ' || ({carried})''')}) < {least}"
    last = "m.done[len(m.done)]"
    line = f"left({strip(f'''split_part(s.body, chr(10), 1)''')}, 60)"
    return rf"""{at_level('##', 'sh2')},
{at_level('###', 'sh3')},
spp AS (SELECT slug, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM {source}),
spk AS (SELECT slug, list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': '', 'n': 0::BIGINT}}, list_transform(ps, lambda p: {{'done': []::VARCHAR[], 'now': p, 'n': len({words('p')})::BIGINT}})),
  lambda a, x: CASE WHEN a.n + x.n > {threshold} AND a.now <> '' THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n}}
    ELSE {{'done': a.done, 'now': CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END, 'n': a.n + x.n}} END) AS r FROM spp),
spa AS (SELECT slug, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS ps FROM spk),
sst AS (SELECT d.slug, CASE WHEN len({words('d.text')}) <= {threshold} THEN 'single' WHEN len(h2.ss) > 1 THEN 'h2' WHEN len(h3.ss) > 1 THEN 'h3' WHEN len(spa.ps) > 1 THEN 'paragraphs' ELSE 'single' END AS strategy,
  h2.pre AS pre2, h2.ss AS ss2, h3.pre AS pre3, h3.ss AS ss3, list_transform(spa.ps, lambda p: {{'heading': '', 'body': p}}) AS ssp
  FROM {source} d JOIN sh2 h2 USING (slug) JOIN sh3 h3 USING (slug) JOIN spa USING (slug)),
sch AS (SELECT slug, CASE strategy WHEN 'h2' THEN pre2 WHEN 'h3' THEN pre3 ELSE '' END AS preamble, CASE strategy WHEN 'h2' THEN ss2 WHEN 'h3' THEN ss3 ELSE ssp END AS ss FROM sst WHERE strategy <> 'single'),
smg AS (SELECT slug, preamble, list_reduce(list_prepend({{'done': []::STRUCT(heading VARCHAR, body VARCHAR)[], 'h': '', 'b': '', 'c': false}}, list_transform(ss, lambda s: {{'done': []::STRUCT(heading VARCHAR, body VARCHAR)[], 'h': s.heading, 'b': s.body, 'c': true}})),
  lambda a, x: CASE WHEN {short} THEN {{'done': a.done, 'h': x.h, 'b': {carried}, 'c': true}} ELSE {{'done': list_append(a.done, {{'heading': x.h, 'body': {carried}}}), 'h': '', 'b': '', 'c': false}} END) AS m FROM sch),
sfn AS (SELECT slug, preamble, CASE WHEN NOT m.c THEN m.done WHEN len(m.done) = 0 THEN [{{'heading': m.h, 'body': m.b}}]
  ELSE list_append(m.done[1:len(m.done) - 1], {{'heading': {last}.heading, 'body': {strip(joined(f'{last}.body', 'm.h', 'm.b'))}}}) END AS ss FROM smg),
secs AS (SELECT * FROM sfn WHERE len(ss) > 1),
skd AS (SELECT slug AS parent, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM secs),
skb AS (SELECT parent, i, s, CASE WHEN s.heading <> '' AND {heading_base('s.heading')} <> '' THEN parent || '-' || ({cut_at_hyphen(heading_base('s.heading'), 30)}) ELSE parent || '-section-' || i END AS base,
  CASE WHEN s.heading <> '' THEN {strip(r"regexp_replace(s.heading, '^#+\s*', '')")} WHEN {line} <> '' THEN {line} ELSE 'Section ' || (i + 1) END AS title FROM skd),
kids AS (SELECT base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS slug, parent, i AS section_index, title, {joined('s.heading', 's.body')} AS body FROM skb WINDOW w AS (PARTITION BY parent, base ORDER BY i))"""
