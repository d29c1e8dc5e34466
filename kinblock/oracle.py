"""DuckDB SQL that checks the registered queries, written apart from the engine's expressions."""

from __future__ import annotations

from .queries import BLOCKS, ENTITY_SQL, SMALL_CAPS, TEXT_SQL

_LEGAL = "l l c|private limited|pvt limited|pvt ltd|private ltd|limited|ltd|corporation|corp|incorporated|inc|llc|pllc|co|company"
_LEGAL_WS = _LEGAL.replace("l l c|", "")
_WEB = "com|net|org|co|in|biz|info|us"
_NAME_32 = (
    "'the','and','company','corporation','corporate','limited','private','pvt','ltd','llc','inc','incorporated','co','group',"
    "'services','service','solutions','solution','enterprises','enterprise','business','businesses','international','india',"
    "'america','american','usa','united','global','official','shop','store'"
)
_NAME_39 = _NAME_32 + ",'mr','mrs','ms','dr','sri','shri','smt'"
_ADDR_21 = (
    "'road','street','st','rd','avenue','ave','lane','ln','drive','dr','highway','hwy','circle','place','building','block',"
    "'floor','near','opposite','opp','main'"
)
_ADDR_25 = _ADDR_21 + ",'pl','india','usa','america'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _basic(c: str) -> str:
    return f"trim(regexp_replace(replace(lower(nfc_normalize(trim({c}))), '&', ' and '), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


def _word(c: str) -> str:
    return f"trim(regexp_replace(replace(lower(trim({c})), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _ascii(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(trim({c}))), '[^a-z0-9]+', ' ', 'g'))"


def _series(c: str) -> str:
    return f"trim(regexp_replace(replace(nfc_normalize(lower({c})), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


ENT = f"ent AS ({ENTITY_SQL.format(part='part')})"
TEXTS = f"ent AS ({TEXT_SQL.format(documents='documents')})"


def signature(form: str = "basic", sets: bool = True, first: bool = False, rows: str = ENT) -> str:
    """CTEs ``ent`` and ``sig``."""
    norm = {"basic": _basic, "word": _word, "series": _series}[form]
    suffix = f"trim(regexp_replace(nm, '(?:\\s+(?:{_LEGAL_WS}))+$', ''))" if form == "series" else f"regexp_replace(nm, '(?:(?:^| )(?:{_LEGAL}))+$', '')"
    name_stop, addr_stop = (_NAME_32, _ADDR_25) if first else (_NAME_39, _ADDR_21)
    some = (lambda x: f"list_sort(list_distinct({x}))") if sets else (lambda x: x)
    return f"""{rows},
n1 AS (SELECT entity_id, src, lower(trim(country)) AS country, {norm("business_name")} AS nm, {norm("business_address")} AS ad,
              regexp_extract_all(business_address, '\\p{{Nd}}+') AS nums FROM ent),
n2 AS (SELECT *, {suffix} AS ns, replace(nm, ' ', '') AS cp FROM n1),
sig AS (SELECT entity_id, src, country, nm, ns, cp, nums,
  replace(regexp_replace(ns, '(?:(?:^| )(?:{_WEB}))+$', ''), ' ', '') AS dom,
  {some(f"list_filter(string_split(nm, ' '), lambda t: length(t) >= 3 AND t NOT IN ({name_stop}))")} AS nt,
  {some(f"list_filter(string_split(ad, ' '), lambda t: length(t) >= 4 AND t NOT IN ({addr_stop}))")} AS atk,
  coalesce(list_filter(nums, lambda x: length(x) <= 5)[1], nums[1], '') AS num,
  list_filter(nums, lambda x: length(x) IN (5, 6)) AS pc
  FROM n2)"""


def _from(select: str, rows: str = TEXTS, **options) -> str:
    return f"WITH {signature(rows=rows, **options)} SELECT entity_id, {select} AS value FROM sig"


def _grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substring({c}, i, 3)))"


#: Family -> (one row per key: k1, k2) as a SELECT over ``sig``.
_FAMILY = {
    "exact_name": "SELECT nm AS k1, '' AS k2",
    "name_no_suffix": "SELECT ns AS k1, '' AS k2",
    "translit_name": "SELECT nm AS k1, '' AS k2",
    "translit_no_suffix": "SELECT ns AS k1, '' AS k2",
    "domain_name": "SELECT dom AS k1, '' AS k2",
    "number": "SELECT num AS k1, '' AS k2",
    "prefix5": "SELECT substring(cp, 1, 5) AS k1, '' AS k2",
    "prefix8": "SELECT substring(cp, 1, 8) AS k1, '' AS k2",
    "translit_prefix6": "SELECT substring(regexp_replace(nm, '[^a-z0-9]', '', 'g'), 1, 6) AS k1, '' AS k2",
    "first_token": "SELECT coalesce(nt[1], '') AS k1, '' AS k2",
    "name_token": "SELECT unnest(nt) AS k1, '' AS k2",
    "translit_token": "SELECT unnest(nt) AS k1, '' AS k2",
    "address_token": "SELECT unnest(atk) AS k1, '' AS k2",
    "postal": "SELECT unnest(pc) AS k1, '' AS k2",
    "name_pair": "SELECT a AS k1, b AS k2 FROM (SELECT unnest(nt) AS a) x, (SELECT unnest(nt) AS b) y WHERE a < b",
    "address_pair": "SELECT a AS k1, b AS k2 FROM (SELECT unnest(atk) AS a) x, (SELECT unnest(atk) AS b) y WHERE a < b",
    "address_token_pair": "SELECT a AS k1, b AS k2 FROM (SELECT unnest(list_distinct(atk)) AS a) x, (SELECT unnest(list_distinct(atk)) AS b) y WHERE a < b",
    "name_address": "SELECT a AS k1, b AS k2 FROM (SELECT unnest(nt) AS a) x, (SELECT unnest(atk) AS b) y",
    "name_number": "SELECT unnest(nt) AS k1, num AS k2 WHERE num <> ''",
    "name_postal": "SELECT a AS k1, b AS k2 FROM (SELECT unnest(nt) AS a) x, (SELECT unnest(pc) AS b) y",
    "number_address": "SELECT num AS k1, unnest(atk) AS k2 WHERE num <> ''",
    "name_ngram": f"SELECT unnest({_grams('cp')}) AS k1, '' AS k2 WHERE length(cp) >= 3",
    "translit_ngram": f"SELECT unnest({_grams('tc')}) AS k1, '' AS k2 FROM (SELECT regexp_replace(nm, '[^a-z0-9]', '', 'g') AS tc) z WHERE length(tc) >= 3",
    "address_ngram": f"SELECT unnest(flatten(list_transform(list_filter(atk, lambda t: length(t) >= 5), lambda t: {_grams('t')}))) AS k1, '' AS k2",
}


def _keys(families, distinct: bool = False, prefix: str = "") -> str:
    """CTE ``ks``: entity_id, src, family, country, k1, k2."""
    d = "DISTINCT " if distinct else ""
    return f"{prefix}ks AS (" + " UNION ALL ".join(
        f"SELECT {d}entity_id, src, '{f}' AS family, country, k1, k2 FROM sig, LATERAL ({_FAMILY[f]}) AS u WHERE k1 <> ''" for f in families
    ) + ")"


_KEY = "family, country, k1, k2"


def _cap(caps: dict[str, int]) -> str:
    return "CASE family " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in caps.items()) + " ELSE 9000000000 END"


def _sizes(p: str = "") -> str:
    return f"""{p}sz AS (SELECT src, {_KEY}, count(*) AS n FROM {p}ks
        WHERE src > 0 AND ({_KEY}) IN (SELECT ({_KEY}) FROM {p}ks WHERE src = 0) GROUP BY src, {_KEY})"""


def _join(caps: dict[str, int], p: str = "") -> str:
    """CTE ``pr``: src, s1, candidate."""
    return f"""{_sizes(p)},
{p}pr AS (SELECT DISTINCT b.src, a.entity_id AS s1, b.entity_id AS candidate
        FROM {p}ks a JOIN {p}ks b USING ({_KEY}) JOIN {p}sz z USING ({_KEY})
        WHERE a.src = 0 AND b.src > 0 AND z.src = b.src AND z.n <= {_cap(caps)})"""


_OUT = "SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, s1, candidate FROM {}"


def _pairs(caps: dict[str, int], distinct: bool = False, **options) -> str:
    return f"WITH {signature(**options)}, {_keys(caps, distinct)}, {_join(caps)} {_OUT.format('pr')}"


def _overlap(family: str, cap: int, p: str = "") -> str:
    return f"""{_keys([family], prefix=p)}, {_sizes(p)},
{p}ov AS (SELECT b.src, a.entity_id AS s1, b.entity_id AS candidate
        FROM {p}ks a JOIN {p}ks b USING ({_KEY}) JOIN {p}sz z USING ({_KEY})
        WHERE a.src = 0 AND b.src > 0 AND z.src = b.src AND z.n <= {cap} GROUP BY ALL HAVING count(*) >= 2)"""


def _rare(budget: dict[str, int], most: int, p: str = "r") -> str:
    """CTEs ``rsel`` (src, s1, KEY, df, rank) and ``rp`` (src, s1, candidate, df)."""
    return f"""{_keys(budget, True, p)},
{p}df AS (SELECT src, {_KEY}, count(*) AS df FROM {p}ks WHERE src > 0 GROUP BY src, {_KEY}),
{p}rk AS (SELECT d.src, k.entity_id AS s1, {_KEY}, df,
        row_number() OVER (PARTITION BY k.entity_id, d.src, family ORDER BY df, k1, k2) AS rank
        FROM {p}ks k JOIN {p}df d USING ({_KEY}) WHERE k.src = 0 AND df <= {most}),
{p}sel AS (SELECT * FROM {p}rk WHERE rank <= {_cap(budget)}),
{p}p AS (SELECT s.src, s.s1, k.entity_id AS candidate, min(s.df) AS df FROM {p}sel s JOIN {p}ks k USING (src, {_KEY}) GROUP BY ALL)"""


TRUTH = """tr AS (SELECT CAST(a.p_partkey AS VARCHAR) AS s1,
        list(DISTINCT CAST(b.p_partkey AS VARCHAR)) FILTER (WHERE b.p_partkey IS NOT NULL) AS targets
    FROM part a LEFT JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND b.p_partkey % 3 > 0
    WHERE a.p_partkey % 3 = 0 GROUP BY a.p_partkey),
tp AS (SELECT s1, unnest(targets) AS target FROM tr)"""

FIRST = {
    "exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "translit_no_suffix": 500, "prefix5": 250, "prefix8": 250,
    "translit_prefix6": 250, "name_token": 150, "translit_token": 150, "address_token": 150, "number": 500, "postal": 500,
}
REAL_SCALE = dict.fromkeys(["exact_name", "name_no_suffix", "prefix5", "first_token", "number", "postal"], 10**12)
SELECTIVE = {"exact_name": 500, "name_no_suffix": 500, "prefix5": 50, "name_token": 50, "number": 50, "postal": 100, "address_token": 50}
COMPOSITE = {
    "exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "translit_no_suffix": 500, "domain_name": 500, "name_postal": 20,
    "name_number": 150, "name_address": 150, "name_pair": 200, "address_pair": 200, "number_address": 75,
}
STRONG = {"exact_name": 500, "name_no_suffix": 500, "translit_name": 500, "domain_name": 500}
STRONG_8 = {**STRONG, "name_postal": 20, "name_number": 150, "name_address": 150, "name_pair": 200}
RARE_V5 = {"name_token": 2, "translit_token": 2, "address_token": 2, "name_ngram": 2, "translit_ngram": 2, "address_ngram": 1}
RESCUE = {"name_token": 2, "translit_token": 2, "address_token": 2, "address_pair": 2, "number_address": 1}
SINGLE = dict.fromkeys(["exact_name", "name_no_suffix", "prefix5", "first_token", "name_token", "number", "postal", "address_token"], 0)
SIX = dict.fromkeys(["name_pair", "address_pair", "name_address", "name_number", "name_postal", "number_address"], 0)


def _hybrid() -> str:
    return f"""WITH {signature()}, {TRUTH}, {_keys(STRONG_8, True)}, {_join(STRONG_8)}, {_rare(RESCUE, 100)},
hard AS (SELECT tr.s1 FROM tr LEFT JOIN (SELECT s1, count(DISTINCT candidate) AS n FROM pr GROUP BY s1) c USING (s1) WHERE coalesce(n, 0) < 20),
res AS (SELECT * FROM rp WHERE s1 IN (SELECT s1 FROM hard))"""


_SWEEP = """,
least AS (SELECT s1, candidate, min(df) AS df FROM (SELECT s1, candidate, 0 AS df FROM pr UNION ALL SELECT s1, candidate, df FROM res) GROUP BY ALL),
th AS (SELECT unnest([0, 10, 25, 50, 100]) AS threshold),
pe AS (SELECT threshold, tr.s1, coalesce(len(targets), 0) AS t,
        (SELECT count(*) FROM least l WHERE l.s1 = tr.s1 AND l.df <= threshold) AS n,
        (SELECT count(*) FROM least l JOIN tp ON tp.s1 = l.s1 AND tp.target = l.candidate WHERE l.s1 = tr.s1 AND l.df <= threshold) AS h
       FROM tr, th),
sw AS (SELECT CAST(threshold AS INTEGER) AS threshold, CAST(sum(t) AS BIGINT) AS total_true, CAST(sum(h) AS BIGINT) AS total_found,
        round(CASE WHEN sum(t) = 0 THEN 0.0 ELSE CAST(sum(h) AS DOUBLE) / sum(t) END, 6) AS recall, round(avg(n), 6) AS avg,
        round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, CAST(max(n) AS BIGINT) AS max FROM pe GROUP BY threshold)"""


def _profile(families, distinct: bool, shares, count: str, **options) -> str:
    share = ", ".join(f"round(avg(CASE WHEN n <= {t} THEN 100.0 ELSE 0.0 END), 6) AS le_{t}" for t in shares)
    q = ", ".join(f"round(quantile_cont(n, {x}), 6) AS {name}" for x, name in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
    return f"""WITH {signature(**options)}, {_keys(families, distinct)}, {_sizes()}
SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, family, count(*) AS {count}, CAST(sum(n) AS BIGINT) AS total_rows, {q}, max(n) AS max, {share}
FROM sz GROUP BY src, family"""


_SINGLE_OPTIONS = {"sets": False}


def _metrics(tail: str) -> str:
    """Recall, statistics and F0.5 of the CTE ``pr`` against the truth, then ``tail``."""
    return f"""ap AS (SELECT DISTINCT s1, candidate FROM pr),
cnt AS (SELECT tr.s1, count(ap.candidate) AS n FROM tr LEFT JOIN ap USING (s1) GROUP BY tr.s1),
hit AS (SELECT tp.* FROM tp JOIN ap ON tp.s1 = ap.s1 AND tp.target = ap.candidate),
tot AS (SELECT (SELECT count(*) FROM tp) AS total_true, (SELECT count(*) FROM hit) AS total_found),
rc AS (SELECT *, round(CASE WHEN total_true = 0 THEN 0.0 ELSE CAST(total_found AS DOUBLE) / total_true END, 6) AS recall FROM tot),
st AS (SELECT round(avg(n), 6) AS avg, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max FROM cnt),
fs AS (SELECT tr.s1, coalesce(len(targets), 0) AS t, n AS p, (SELECT count(*) FROM hit WHERE hit.s1 = tr.s1) AS tp FROM tr JOIN cnt USING (s1)),
f AS (SELECT s1, round(CASE WHEN t = 0 AND p = 0 THEN 1.0 WHEN t = 0 OR p = 0 OR tp = 0 THEN 0.0
        ELSE 1.25 * (tp / p) * (tp / t) / (0.25 * (tp / p) + (tp / t)) END, 6) AS f05
      FROM (SELECT s1, CAST(t AS DOUBLE) AS t, CAST(p AS DOUBLE) AS p, CAST(tp AS DOUBLE) AS tp FROM fs))
{tail}"""


def _scored(tail: str) -> str:
    return f"WITH {signature()}, {TRUTH}, {_keys(COMPOSITE)}, {_join(COMPOSITE)}, {_metrics(tail)}"


def oracle_sql() -> dict[str, str]:
    text = lambda e: f"WITH {TEXTS} SELECT entity_id, {e} AS value FROM ent"
    joined = lambda e: f"array_to_string({e}, '|')"
    plus = lambda e: f"array_to_string(list_transform({e}, lambda p: p.a || '+' || p.b), '|')"
    out = {
        "cand_v4": _pairs(COMPOSITE),
        "norm_basic": text(_basic("business_name")),
        "norm_compact": text(f"replace({_basic('business_name')}, ' ', '')"),
        "strip_suffix": _from("ns"),
        "strip_suffix_ws": _from("ns", form="series"),
        "norm_word": text(_word("business_name")),
        "norm_word_series": text(_series("business_name")),
        "norm_country": text("lower(trim(country))"),
        "transliterate": text(_basic("business_name")),
        "domain_name": _from("dom"),
        "numbers": _from(joined("nums")),
        "first_number": _from("num"),
        "postal_codes": _from(joined("pc")),
        "name_tokens": _from(joined("nt"), sets=False),
        "name_tokens_set": _from(joined("nt")),
        "address_tokens": _from(joined("atk"), sets=False),
        "first_token": _from("coalesce(nt[1], '')", sets=False),
        "prefix5": _from("substring(cp, 1, 5)"),
        "prefix8": _from("substring(cp, 1, 8)"),
        "translit_prefix": _from("substring(regexp_replace(nm, '[^a-z0-9]', '', 'g'), 1, 6)"),
        "token_pairs": _from(plus("flatten(list_transform(range(1, len(atk) + 1), lambda i: list_transform(range(i + 1, len(atk) + 1), lambda j: {'a': atk[i], 'b': atk[j]})))"), ENT),
        "cross_keys": _from(plus("flatten(list_transform(nt, lambda x: list_transform(pc, lambda y: {'a': x, 'b': y})))")),
        "pair_key": _from("country || '|' || least(coalesce(nt[1], ''), num) || '|' || greatest(coalesce(nt[1], ''), num)"),
        "char_ngrams": _from(f"CASE WHEN length(cp) >= 3 THEN array_to_string(list_sort({_grams('cp')}), '|') ELSE '' END"),
        "name_features": f"WITH {signature(rows=TEXTS)} SELECT s.entity_id, {_strip('business_name')} AS raw, nm AS basic, cp AS compact, ns AS no_suffix, nm AS transliterated FROM sig s JOIN ent USING (entity_id)",
        "address_features": f"""WITH {signature(rows=TEXTS)} SELECT s.entity_id, {_strip('business_address')} AS raw, ad AS basic, replace(ad, ' ', '') AS compact,
            array_to_string(nums, ' ') AS numbers, CAST(len(nums) AS BIGINT) AS n_numbers FROM n1 s JOIN ent USING (entity_id)""",
        "truth_pairs": f"WITH {TRUTH} SELECT * FROM tp",
    }
    for family, (cap, style) in BLOCKS.items():
        for name, c in ((f"block_{family}", cap), (f"block_{family}_small_cap", SMALL_CAPS[family])):
            out[name] = _pairs({family: c}, sets=style.sets)
    out |= {
        "block_exact_name_uncapped": _pairs({"exact_name": 10**12}),
        "overlap_tokens": f"WITH {signature(sets=False, first=True)}, {_overlap('address_token', 1000)} {_OUT.format('ov')}",
        "overlap_ngrams": f"WITH {signature(sets=False, first=True)}, {_overlap('address_ngram', 300)} {_OUT.format('ov')}",
        "cand_v3": f"""WITH {signature(sets=False, first=True)}, {_keys(FIRST)}, {_join(FIRST)}, {_overlap('address_token', 1000, 't')}, {_overlap('address_ngram', 300, 'g')},
            al AS (SELECT * FROM pr UNION SELECT * FROM tov UNION SELECT * FROM gov) {_OUT.format('al')} WHERE s1 <> candidate""",
        "cand_real_scale": _pairs(REAL_SCALE, form="series", sets=False),
        "cand_selective": _pairs(SELECTIVE, sets=False),
        "cand_selective_small_cap": _pairs({f: SMALL_CAPS[f] for f in SELECTIVE}, sets=False),
        "cand_adaptive": f"""WITH {signature()}, {_keys(STRONG, True)}, {_join(STRONG)}, {_rare(RARE_V5, 500)},
            al AS (SELECT src, s1, candidate FROM pr UNION SELECT src, s1, candidate FROM rp) {_OUT.format('al')}""",
        "cand_hybrid": f"{_hybrid()}, al AS (SELECT src, s1, candidate FROM pr UNION SELECT src, s1, candidate FROM res) {_OUT.format('al')}",
        "hybrid_sweep": f"{_hybrid()}{_SWEEP} SELECT * FROM sw",
        "hybrid_best": f"{_hybrid()}{_SWEEP} SELECT * FROM sw WHERE avg <= 1000 ORDER BY recall DESC, threshold LIMIT 1",
        "hybrid_rescue_only": f"WITH {signature()}, {_rare(RESCUE, 100)} {_OUT.format('rp')}",
        "profile_single": _profile(SINGLE, False, (10, 25, 50, 100, 500), "keys_seen", **_SINGLE_OPTIONS),
        "profile_composite": _profile(SIX, True, (10, 25, 50, 100, 250, 500), "keys", form="word"),
        "top_blocks": f"""WITH {signature(**_SINGLE_OPTIONS)}, {_keys(SINGLE)}, {_sizes()},
            rk AS (SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, {_KEY}, n,
                   CAST(row_number() OVER (PARTITION BY src, family ORDER BY n DESC, country, k1, k2) AS INTEGER) AS rank FROM sz)
            SELECT * FROM rk WHERE rank <= 10""",
        "overflow_stats": f"""WITH {signature(**_SINGLE_OPTIONS)}, {_keys(SINGLE)}, {_sizes()}
            SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, family, count(*) AS keys, count(*) FILTER (WHERE n <= c) AS usable, count(*) FILTER (WHERE n > c) AS overflowed
            FROM (SELECT *, {_cap(SELECTIVE | {"first_token": 50})} AS c FROM sz) GROUP BY ALL""",
        "universe_counts": f"WITH {signature()}, {_keys(COMPOSITE)} SELECT family, count(*) AS keys FROM (SELECT DISTINCT {_KEY} FROM ks WHERE src = 0) GROUP BY family",
        "selected_keys": f"WITH {signature()}, {_rare(RESCUE, 100)} SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, s1, family, k1, k2, df, CAST(rank AS INTEGER) AS rank FROM rsel",
        "selected_key_stats": f"WITH {signature()}, {_rare(RESCUE, 100)} SELECT 'S' || CAST(src + 1 AS VARCHAR) AS source, family, count(*) AS selected FROM rsel GROUP BY ALL",
        "positive_coverage": f"""WITH {signature(form="word")}, {TRUTH}, {_keys(SIX, True)},
            sh AS (SELECT DISTINCT a.entity_id AS s1, b.entity_id AS target, family FROM ks a JOIN ks b USING ({_KEY}) WHERE a.src = 0 AND b.src > 0)
            SELECT s1, target, {", ".join(f"EXISTS (SELECT 1 FROM sh WHERE sh.s1 = tp.s1 AND sh.target = tp.target AND family = '{f}') AS {f}" for f in SIX)} FROM tp""",
        "totals": f"""WITH {ENT}, {TRUTH} SELECT 'S' || CAST(src + 1 AS VARCHAR) AS what, count(*) AS n FROM ent GROUP BY src
            UNION ALL SELECT 'truth entities', count(*) FROM tr UNION ALL SELECT 'truth pairs', count(*) FROM tp""",
        "transliterate_ascii": text(_ascii("business_name")),
        "block_translit_name_ascii": f"""WITH {TEXTS}, a AS (SELECT entity_id, src, coalesce(lower(trim(country)), '') AS country, {_ascii('business_name')} AS k FROM ent),
            z AS (SELECT src, country, k, count(*) AS n FROM a WHERE src > 0 GROUP BY ALL)
            SELECT DISTINCT 'S' || CAST(y.src + 1 AS VARCHAR) AS source, x.entity_id AS s1, y.entity_id AS candidate
            FROM a x JOIN a y USING (country, k) JOIN z USING (country, k) WHERE x.src = 0 AND y.src > 0 AND z.src = y.src AND k <> '' AND z.n <= 500""",
        "pair_table": f"""WITH {signature(sets=False, first=True)}, {_keys(FIRST)}, {_join(FIRST)}, {_overlap('address_token', 1000, 't')}, {_overlap('address_ngram', 300, 'g')},
            al AS (SELECT * FROM pr UNION SELECT * FROM tov UNION SELECT * FROM gov) SELECT s1 AS source1_entity_id, candidate AS candidate_entity_id FROM al WHERE s1 <> candidate""",
        "tsv_cand_v4": _pairs(COMPOSITE),
        "tsv_truth": f"WITH {TRUTH} SELECT * FROM tp",
        "candidate_file": f"WITH {signature()}, {_keys(COMPOSITE)}, {_join(COMPOSITE)} SELECT s1 AS item_id_1, candidate AS item_id_2, 'composite' AS blocking_key FROM pr",
        "match_file": f"WITH {TRUTH} SELECT s1 AS item_id_1, target AS item_id_2, '0.5' AS match_score, '1' AS is_match FROM tp",
        "profile_file": f"SELECT source, family, keys_seen, total_rows, max FROM ({_profile(SINGLE, False, (10,), 'keys_seen', **_SINGLE_OPTIONS)})",
        "in_memory_rows": "SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS business_name, '' AS business_address, '' AS country FROM nation",
        "eval_selective": f"WITH {signature(sets=False)}, {TRUTH}, {_keys(SELECTIVE)}, {_join(SELECTIVE)}, {_metrics('SELECT * FROM rc, st')}",
        "eval_adaptive": f"""WITH {signature()}, {TRUTH}, {_keys(STRONG, True, 'b')}, {_join(STRONG, 'b')}, {_rare(RARE_V5, 500)},
            pr AS (SELECT src, s1, candidate FROM bpr UNION SELECT src, s1, candidate FROM rp), {_metrics('SELECT * FROM rc, st')}""",
        "eval_v3": f"""WITH {signature(sets=False, first=True)}, {TRUTH}, {_keys(FIRST, prefix='b')}, {_join(FIRST, 'b')}, {_overlap('address_token', 1000, 't')}, {_overlap('address_ngram', 300, 'g')},
            pr AS (SELECT * FROM (SELECT * FROM bpr UNION SELECT * FROM tov UNION SELECT * FROM gov) WHERE s1 <> candidate), {_metrics('SELECT * FROM rc, st')}""",
        "eval_real_scale": f"""WITH {signature(form='series', sets=False)}, {TRUTH}, {_keys(REAL_SCALE)}, {_join(REAL_SCALE)}, {_metrics('SELECT * FROM rc, st')}""",
        "index_sizes": f"WITH {signature(sets=False, first=True)}, {_keys([*FIRST, 'address_ngram', 'address_token_pair'])} SELECT family, count(*) AS n FROM ks GROUP BY family",
        "recall": _scored("SELECT * FROM rc"),
        "missing_pairs": _scored("SELECT * FROM tp EXCEPT SELECT * FROM hit"),
        "missing_top30": _scored("SELECT * FROM (SELECT * FROM tp EXCEPT SELECT * FROM hit) ORDER BY s1, target LIMIT 30"),
        "candidate_stats": _scored("SELECT * FROM st"),
        "evaluation": _scored("SELECT * FROM rc, st"),
        "f05_per_entity": _scored("SELECT * FROM f"),
        "macro_f05": _scored("SELECT round(avg(f05), 6) AS macro_f05 FROM f"),
    }
    return out
