"""Entity extraction, command synthesis, code metrics and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import calendar, code_metrics, entities, synth
from .profile_queries import sql_strip
from .registry import query, spread, table

RE2 = tx.BLANK_RE2


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- entities --------------------------------------------------------------------

# The same text builds the sentence on both sides: courtesy around a command
# made from the part's name and size.
HEAD = "CASE p_size % 5 WHEN 0 THEN 'hey ' WHEN 1 THEN 'Please ' WHEN 2 THEN 'so, could you ' WHEN 3 THEN '  Okay kindly ' ELSE '' END"
TAIL = "CASE p_partkey % 6 WHEN 0 THEN ' please' WHEN 1 THEN ' right now!' WHEN 2 THEN '.' WHEN 3 THEN ' for me ??' ELSE '' END"
THING = "CASE p_partkey % 7 WHEN 0 THEN 'chrome' WHEN 1 THEN 'VS Code' WHEN 2 THEN 'Downloads' WHEN 3 THEN upper(p_name) ELSE p_name END"
FOLDER = "CASE p_partkey % 4 WHEN 0 THEN 'Music' WHEN 1 THEN 'desktop' ELSE p_brand END"
FILE = "replace(p_name, ' ', '_') || '.txt'"

SENTENCES = {
    "open_app": f"CASE p_size % 6 WHEN 0 THEN 'fire up ' WHEN 1 THEN 'Open up ' WHEN 2 THEN 'i need ' ELSE 'open ' END || {THING}",
    "close_app": f"CASE p_size % 4 WHEN 0 THEN 'shut down ' WHEN 1 THEN 'get rid of ' ELSE 'quit ' END || {THING}",
    "create_folder": f"CASE p_size % 3 WHEN 0 THEN 'create a folder called ' WHEN 1 THEN 'make  directory ' ELSE 'delete folder ' END || {FOLDER}",
    "delete_file": f"CASE p_size % 3 WHEN 0 THEN 'delete ' WHEN 1 THEN 'remove the file ' ELSE 'get rid of ' END || {FILE}",
    "rename_file": f"CASE p_size % 2 WHEN 0 THEN 'rename ' ELSE 'rename the file ' END || {FILE} || ' to new to ' || p_type",
    "copy_file": f"CASE p_size % 3 WHEN 0 THEN 'copy ' WHEN 1 THEN 'duplicate a copy of ' ELSE 'paste ' END || {FILE} || ' to ' || {FOLDER}",
    "move_file": f"'move ' || {FILE} || '  to ' || {FOLDER}",
    "search_web": f"CASE p_size % 4 WHEN 0 THEN 'search the web for ' WHEN 1 THEN 'google ' WHEN 2 THEN 'look up ' ELSE '' END || p_name",
    "youtube_search": f"CASE p_size % 3 WHEN 0 THEN 'search for ' WHEN 1 THEN 'play ' ELSE 'find ' END || p_name || CASE p_partkey % 2 WHEN 0 THEN ' on YouTube' ELSE ' on yt' END",
    "set_volume": "CASE p_size % 4 WHEN 0 THEN 'set volume to ' || p_size || ' of 100' WHEN 1 THEN 'make it louder' WHEN 2 THEN 'reduce the sound' ELSE p_name END",
    "open_project": f"CASE p_size % 3 WHEN 0 THEN 'open my ' || p_name || ' project' WHEN 1 THEN 'load project ' || p_name ELSE 'launch ' || p_name END",
    "run_command": "CASE p_size % 3 WHEN 0 THEN 'run command ' WHEN 1 THEN 'execute ' ELSE 'run ' END || p_name",
}


def sql_filler(s: str) -> str:
    head = f"regexp_replace({s}, {quoted(tx.dialect(tx.LEADING_COURTESY, RE2))}, '', 'i')"
    return sql_strip(f"regexp_replace({head}, {quoted(tx.dialect(tx.TRAILING_COURTESY, RE2))}, '', 'i')")


def sql_verbs(s: str, verbs) -> str:
    pattern = "^(" + "|".join(verbs) + f"){RE2}+"
    return sql_strip(f"regexp_replace({s}, {quoted(pattern)}, '', 'i')")


def sql_group(s: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({s}, {quoted(tx.dialect(pattern, RE2))}, {group}, 'i'), '')"


def sql_without(s: str, pattern: str) -> str:
    return sql_strip(f"regexp_replace({s}, {quoted(tx.dialect(pattern, RE2))}, '', 'i')")


def sql_normal(s: str, aliases: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in aliases.items())
    v = sql_strip(s)
    title = (
        f"array_to_string(list_transform(regexp_extract_all({v}, '[a-z]+|[^a-z]+'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )
    return (
        f"CASE lower({v}) {cases} ELSE CASE WHEN {v} = lower({v}) AND {v} <> upper({v}) THEN {title} ELSE {v} END END"
    )


_LEVEL = "try_cast(nullif(regexp_extract(s, '[0-9]+'), '') AS BIGINT)"
_UP, _DOWN = "|".join(tx.UP_WORDS), "|".join(tx.DOWN_WORDS)
FIELDS_SQL = {
    "open_app": {"app": sql_normal(f"nullif({sql_verbs('s', entities.OPEN_VERBS)}, '')", entities.APP_ALIASES)},
    "close_app": {"app": sql_normal(f"nullif({sql_verbs('s', entities.CLOSE_VERBS)}, '')", entities.APP_ALIASES)},
    "create_folder": {"folder_name": sql_normal(sql_group("s", entities.FOLDER_SHAPE, 1), entities.FOLDER_ALIASES)},
    "delete_file": {"path": f"nullif({sql_without(sql_verbs('s', entities.DELETE_VERBS), entities.THE_FILE)}, '')"},
    "rename_file": {
        "old_name": sql_strip(sql_group("s", entities.RENAME_SHAPE, 1)),
        "new_name": sql_strip(sql_group("s", entities.RENAME_SHAPE, 2)),
    },
    "copy_file": {
        "source": sql_strip(sql_group("s", entities.COPY_SHAPE, 1)),
        "destination": sql_normal(sql_group("s", entities.COPY_SHAPE, 2), entities.FOLDER_ALIASES),
    },
    "move_file": {
        "source": sql_strip(sql_group("s", entities.MOVE_SHAPE, 1)),
        "destination": sql_normal(sql_group("s", entities.MOVE_SHAPE, 2), entities.FOLDER_ALIASES),
    },
    "search_web": {"query": f"nullif({sql_without('s', entities.WEB_LEAD)}, '')"},
    "youtube_search": {
        "query": f"nullif({sql_without(sql_without('s', entities.VIDEO_LEAD), entities.VIDEO_TAIL)}, '')"
    },
    "set_volume": {
        "value": _LEVEL,
        "direction": f"CASE WHEN {_LEVEL} IS NULL THEN CASE WHEN regexp_matches(lower(s), '{_UP}') THEN 'up' "
                     f"WHEN regexp_matches(lower(s), '{_DOWN}') THEN 'down' END END",
    },
    "open_project": {"project": sql_strip(sql_group("s", entities.PROJECT_SHAPE, 1))},
    "run_command": {"command": f"nullif({sql_without('s', entities.COMMAND_LEAD)}, '')"},
}
# The other intents of the dispatch: those with the same rule as one above, with a given result, or with none.
SAME_RULE = {
    "delete_folder": "create_folder", "volume_set": "set_volume", "brightness_set": "set_volume", "set_brightness": "set_volume",
}
GIVEN = {"volume_up": "up", "volume_down": "down", "brightness_up": "up", "brightness_down": "down"}
NO_FIELDS = ("mute", "unmute", "shutdown_pc", "restart_pc", "sleep_pc", "lock_pc", "logout", "general_chat", "unknown")
ALL_FIELDS_SQL = {
    **FIELDS_SQL, **{k: FIELDS_SQL[v] for k, v in SAME_RULE.items()},
    **{k: {"direction": quoted(v)} for k, v in GIVEN.items()}, **{k: {} for k in NO_FIELDS},
}
ALL_SENTENCES = {k: SENTENCES[SAME_RULE.get(k, k if k in SENTENCES else "set_volume")] for k in ALL_FIELDS_SQL}


def _sentence(intent: str) -> str:
    return f"{HEAD} || {ALL_SENTENCES[intent]} || {TAIL}"


def _register_entity_query(intent: str) -> None:
    fields = FIELDS_SQL[intent]
    chosen = ", ".join(f"{expr} AS {name}" for name, expr in fields.items())

    def run(spark, d):
        rows = spread(table(spark, d, "part")).select(
            "p_partkey", F.expr(_sentence(intent)).alias("text"), F.lit(intent).alias("intent")
        )
        found = entities.extract_entities(rows)
        out = found.select("p_partkey", *[F.col(f"entities.{name}").alias(name) for name in fields])
        return out.withColumn("value", F.col("value").cast("bigint")) if "value" in fields else out

    sql = f"SELECT p_partkey, {chosen} FROM (SELECT p_partkey, {sql_filler(_sentence(intent))} AS s FROM part)"
    query(f"entities_{intent}", sql)(run)


for _intent in SENTENCES:
    _register_entity_query(_intent)


@query("strip_filler", f"SELECT conv_id, turn, {sql_filler('text')} AS clean FROM conversations")
def strip_filler(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.strip_filler("text").alias("clean"))


def _dispatch_sql() -> str:
    branches = []
    for i, (intent, fields) in enumerate(ALL_FIELDS_SQL.items()):
        listed = ", ".join(f"({fields[f]})::VARCHAR AS {f}" if f in fields else f"NULL::VARCHAR AS {f}" for f in entities.FIELDS)
        rows = f"(SELECT p_partkey, {sql_filler(_sentence(intent))} AS s FROM part WHERE p_partkey % {len(ALL_FIELDS_SQL)} = {i})"
        branches.append(f"SELECT p_partkey, '{intent}' AS intent, {listed} FROM {rows}")
    return " UNION ALL ".join(branches)


@query("entities_dispatch", _dispatch_sql())
def entities_dispatch(spark, d):
    """Every part as a command whose intent changes from row to row."""
    intents = list(ALL_FIELDS_SQL)
    sentence = F.coalesce(*[
        F.when(F.col("p_partkey") % len(intents) == i, F.expr(_sentence(name))) for i, name in enumerate(intents)
    ])
    intent = F.element_at(
        F.array(*[F.lit(i) for i in intents]), (F.col("p_partkey") % len(intents) + 1).cast("int")
    )
    rows = spread(table(spark, d, "part")).select("p_partkey", sentence.alias("text"), intent.alias("intent"))
    found = entities.extract_entities(rows)
    return found.select("p_partkey", "intent", *[F.col(f"entities.{f}").cast("string").alias(f) for f in entities.FIELDS])


_JSON_FIELDS = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '\"{f}\":' || to_json({f}) END" for f in entities.FIELDS)


@query("entities_json", f"""
SELECT p_partkey, intent, '{{' || array_to_string(list_filter([{_JSON_FIELDS}], lambda x: x IS NOT NULL), ',') || '}}' AS entities
FROM ({_dispatch_sql()})""")
def entities_json(spark, d):
    """The same as JSON payloads that show only what was found."""
    found = entities_dispatch(spark, d)
    return found.select("p_partkey", "intent", F.to_json(F.struct(*entities.FIELDS)).alias("entities"))


# --- command synthesis -----------------------------------------------------------

TEMPLATES = ("open {x}", "find {x}", "please show me {x}", "where is {x}")
SHORT = {"small ring": ["ring", "sr"]}
TYPO = {"red widget": ["red wigdet"], "hot gear": ["hot geer", "hto gear"]}
MISHEARD = {"blue bolt": ["blew bolt"]}


def sql_fraction(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_choose(values, *key: str) -> str:
    listed = "[" + ", ".join(quoted(v) for v in values) + "]"
    return f"({listed})[floor({sql_fraction(*key)} * {len(values)})::INT + 1]"


def _alternatives() -> str:
    key = ("'42'", "p_partkey::VARCHAR")
    r = sql_fraction("'substitute'", *key)
    out = []
    for below, forms in ((synth.SHORT_BELOW, SHORT), (synth.TYPO_BELOW, TYPO), (synth.MISHEARD_BELOW, MISHEARD)):
        for value, options in forms.items():
            out.append(f"WHEN slot = {quoted(value)} AND {r} < {below} THEN {sql_choose(options, chr(39) + 'form' + chr(39), *key)}")
    return "CASE " + " ".join(out) + " END"


_MARKS = " ".join(f"WHEN mark < {b} THEN {quoted(m)}" for b, m in synth.MARKS)


def sql_noise(source: str, ids: str, key: tuple[str, ...], reasons: bool) -> str:
    """Common table expressions that end in ``noisy``: ``source`` with the text of its sentence ``s``."""
    share = synth.REASON_SHARE if reasons else 0
    polite = "|".join(synth.POLITE)
    base = sql_strip(
        f"CASE WHEN regexp_matches(lower(s), '{polite}') THEN '' ELSE "
        + sql_choose(synth.FILLERS, "'filler'", *key) + " END || s || " + sql_choose(synth.TAILS, "'tail'", *key)
    )
    cased = sql_strip(
        f"CASE WHEN c < {synth.LOWER_BELOW} THEN lower(marked) WHEN c < {synth.UPPER_BELOW} THEN upper(marked) "
        f"WHEN c < {synth.MIXED_BELOW} THEN mixed ELSE marked END"
    )
    letter = sql_fraction("'letter'", "i::VARCHAR", *key)
    return f"""
t AS (SELECT *, {base} AS base, {sql_fraction("'mark'", *key)} AS mark, {sql_fraction("'case'", *key)} AS c,
      {sql_fraction("'context'", *key)} AS context, {sql_choose(synth.REASONS, "'reason'", *key)} AS reason FROM {source}),
m AS (SELECT *, CASE WHEN context < {share} THEN base || ' ' || reason ELSE base END
             || CASE {_MARKS} ELSE '' END AS marked FROM t),
x AS (SELECT *, unnest(string_split(marked, '')) AS ch, generate_subscripts(string_split(marked, ''), 1) - 1 AS i FROM m
      WHERE c >= {synth.UPPER_BELOW} AND c < {synth.MIXED_BELOW}),
mixed AS (SELECT {ids}, string_agg(CASE WHEN {letter} < 0.5 THEN upper(ch) ELSE lower(ch) END, '' ORDER BY i) AS mixed
          FROM x GROUP BY {ids}),
noisy AS (SELECT *, {cased} AS text FROM m LEFT JOIN mixed USING ({ids}))"""


SQL_COMMANDS = f"""
d AS (SELECT p_partkey, p_name AS slot,
             {sql_choose(TEMPLATES, "'template'", "'42'", "p_partkey::VARCHAR")} AS template FROM part),
a AS (SELECT *, {_alternatives()} AS alt FROM d),
v AS (SELECT p_partkey, slot, variant, replace(template, '{{x}}', slot) AS s FROM a, (SELECT unnest([1, 2, 3]) AS variant)
      UNION ALL SELECT p_partkey, slot, 4, replace(template, '{{x}}', alt) FROM a WHERE alt IS NOT NULL),
{sql_noise("v", "p_partkey, variant", ("'42'", "p_partkey::VARCHAR", "variant::VARCHAR"), True)}"""


def _commands(spark, d):
    draws = spread(table(spark, d, "part").select("p_partkey", "p_name"))
    options = F.array(*[F.lit(t) for t in TEMPLATES])
    filled = synth.fill_draws(draws, "p_partkey", options, F.col("p_name"))
    return synth.noisy_variants(filled, "p_partkey", short=SHORT, typo=TYPO, misheard=MISHEARD)


@query("noisy_commands", f"WITH {SQL_COMMANDS} SELECT p_partkey, variant, text, slot FROM noisy")
def noisy_commands(spark, d):
    return _commands(spark, d).select("p_partkey", "variant", "text", "slot")


@query("slot_values", """
SELECT p_partkey, (i - 1)::INT AS slot_no, v AS slot_value
FROM (SELECT p_partkey, unnest(string_split(p_brand || ';' || p_type, ';')) AS v,
             generate_subscripts(string_split(p_brand || ';' || p_type, ';'), 1) AS i FROM part)""")
def slot_values(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(";", "p_brand", "p_type").alias("slot"))
    return synth.slot_values(rows).drop("slot")


@query("compound_commands", f"""
WITH v AS (SELECT p_partkey, p_name || ';' || p_brand AS slot,
                  'open ' || p_name || {sql_choose(synth.CONNECTORS, "'connector'", "'42'", "p_partkey::VARCHAR")}
                  || 'close ' || p_brand AS s FROM part),
{sql_noise("v", "p_partkey", ("'42'", "p_partkey::VARCHAR"), False)}
SELECT p_partkey, text, 'multi_intent' AS intent, slot FROM noisy""")
def compound_commands(spark, d):
    draws = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    out = synth.compound_commands(
        draws, "p_partkey", F.concat(F.lit("open "), "p_name"), F.concat(F.lit("close "), "p_brand"),
        [F.col("p_name"), F.col("p_brand")],
    )
    return out.select("p_partkey", "text", "intent", "slot")


_SPLIT_KEY = "md5('42|' || p_partkey::VARCHAR || '|' || variant::VARCHAR)"


@query("balance_and_split", f"""
WITH {SQL_COMMANDS},
u AS (SELECT p_partkey, variant, slot AS intent FROM noisy
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY p_partkey, variant) = 1),
k AS (SELECT least(max(n), greatest(3 * min(n), 300)) AS cap FROM (SELECT count(*) AS n FROM u GROUP BY intent)),
b AS (SELECT p_partkey, variant, intent FROM u, k
      QUALIFY row_number() OVER (PARTITION BY intent ORDER BY {_SPLIT_KEY}) <= cap)
SELECT p_partkey, variant, intent, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
       WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {_SPLIT_KEY}) AS rn, count(*) OVER () AS n FROM b)""")
def balance_and_split(spark, d):
    rows = _commands(spark, d).select("p_partkey", "variant", "text", F.col("slot").alias("intent"))
    return synth.balance_and_split(rows, ["p_partkey", "variant"]).select("p_partkey", "variant", "intent", "split")


# --- code metrics ----------------------------------------------------------------

# Small functions in six languages, branching as often as the line number says.
CODE = {
    "python": "'def f' || l_partkey || '(x):' || chr(10) || '    # if for while' || chr(10) || chr(10)"
              " || repeat('    if x and \"or #\" != x:' || chr(10) || '        x += 1' || chr(10), l_linenumber) || '    return x'",
    "java": "'public int f(int a) { // if' || chr(10)"
            " || repeat('  for (int i = 0; i < a; i++) { a += a > 1 ? \"&&\".length() : 2; }' || chr(10), l_linenumber) || '  return a; }'",
    "javascript": "'function f(a) { /* if' || chr(10) || ' for */' || chr(10)"
                  " || repeat('  if (a && b || c) { a = `while`; }' || chr(10), l_linenumber) || '}'",
    "php": "'function f($a) { # if' || chr(10)"
           " || repeat('  foreach ($a as $b) { if ($b) { $c = \"if\"; } }' || chr(10), l_linenumber) || '}'",
    "ruby": "'def f(a)' || chr(10) || '  # if' || chr(10)"
            " || repeat('  x = a ? 1 : 2 unless a.empty?' || chr(10), l_linenumber) || 'end'",
    "go": "'func f(a int) int { // if' || chr(10)"
          " || repeat('  switch a { case 1: a = 2; case 3: a++ }' || chr(10), l_linenumber) || '}'",
}
LANGUAGES = tuple(CODE)


def _code_case(side: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {CODE[n]}" for i, n in enumerate(LANGUAGES))
    return f"CASE l_suppkey % 6 {cases} END"


def _language_case(choose) -> str:
    return "CASE language " + " ".join(f"WHEN '{n}' THEN {choose(n)}" for n in LANGUAGES) + " END"


def _sql_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {quoted(pattern)}))"


_NAMES = "CASE l_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LANGUAGES)) + " END"


def _functions_sql(n: str) -> str:
    count = _sql_count("plain", code_metrics.FUNCTIONS[n])
    return f"{count} - {_sql_count('plain', code_metrics.NOT_FUNCTIONS[n])}" if n in code_metrics.NOT_FUNCTIONS else count


def _bare_sql(n: str) -> str:
    pattern = quoted("(" + code_metrics.re2(code_metrics.STRINGS[n]) + ")|" + code_metrics.COMMENTS[n])
    return f"regexp_replace(code, {pattern}, '\\1', 'g')"


def _plain_sql(n: str) -> str:
    return f"regexp_replace(bare, {quoted(code_metrics.re2(code_metrics.STRINGS[n]))}, 's', 'g')"


SQL_CODE = f"""
c AS (SELECT l_orderkey, l_linenumber, language,
             CASE WHEN language = 'php' THEN '<?php' || chr(10) || code ELSE code END AS code
      FROM (SELECT l_orderkey, l_linenumber, {_NAMES} AS language, {_code_case('sql')} AS code FROM lineitem)),
b AS (SELECT *, {_language_case(_bare_sql)} AS bare FROM c),
q AS (SELECT *, {_language_case(_plain_sql)} AS plain FROM b),
measured AS (SELECT l_orderkey, l_linenumber, language, code,
       ({_language_case(_functions_sql)})::INT AS n_functions,
       (1 + {_language_case(lambda n: _sql_count('plain', code_metrics.DECISIONS[n]))})::INT AS cyclomatic_complexity,
       {_sql_count('bare', code_metrics.CODE_LINE)}::INT AS nloc,
       {_sql_count('plain', code_metrics.TOKEN)}::INT AS token_count FROM q),
metrics AS (SELECT * EXCLUDE (code) FROM measured)"""


def _snippets(spark, d):
    return spread(table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", F.expr(_NAMES).alias("language"), F.expr(_code_case("spark")).alias("code")
    )


@query("code_metrics", f"WITH {SQL_CODE} SELECT * FROM metrics")
def measure_code(spark, d):
    return code_metrics.code_metrics(_snippets(spark, d)).drop("code")


@query("label_code", f"""
WITH {SQL_CODE}
SELECT l_orderkey, l_linenumber, language, cyclomatic_complexity, nloc, token_count,
       CASE language WHEN 'python' THEN 0 WHEN 'java' THEN 1 WHEN 'javascript' THEN 2 WHEN 'php' THEN 3
            WHEN 'ruby' THEN 4 ELSE 5 END AS language_id
FROM metrics WHERE n_functions = 1""")
def label_code(spark, d):
    rows = _snippets(spark, d).withColumn("original_string", F.lit(None).cast("string"))
    return code_metrics.label_code(rows, ["l_orderkey", "l_linenumber"]).drop("code")


# --- calendar --------------------------------------------------------------------

EVENT_COLORS = {
    "view": "#3fd67a", "click": "#ffc94d", "signup": "#4aa3ff", "purchase": "#c96a35", "error": "#7f1020",
}
SQL_MINUTES = """
per AS (SELECT ts::DATE AS date, event_type AS platform, sum(trunc(value)::BIGINT)::BIGINT AS minutes
        FROM events GROUP BY 1, 2 HAVING sum(trunc(value)::BIGINT) > 0)"""
SQL_CELLS = f"""{SQL_MINUTES},
daily AS (SELECT date, sum(minutes)::BIGINT AS total, count(*) AS n FROM per GROUP BY date),
spine AS (SELECT unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date
          FROM (SELECT DISTINCT date_trunc('month', date)::TIMESTAMP AS m FROM daily)),
cells AS (SELECT date, coalesce(total, 0) AS total, coalesce(n, 0) AS n, year(date)::INT AS year, month(date)::INT AS month,
                 strftime(date, '%b') AS month_label, (isodow(date) - 1)::INT AS weekday,
                 ((isodow(date_trunc('month', date)) - 1 + day(date) - 1) // 7)::INT AS week_index
          FROM spine LEFT JOIN daily USING (date))"""


@query("platform_minutes", f"WITH {SQL_MINUTES} SELECT date, platform, minutes FROM per")
def platform_minutes(spark, d):
    return calendar.platform_minutes(table(spark, d, "events"), "ts", "event_type", "value")


@query("daily_activity", f"""
WITH {SQL_MINUTES}
SELECT date, string_agg(platform || '=' || minutes, ';' ORDER BY platform) AS activity, sum(minutes)::BIGINT AS total
FROM per GROUP BY date""")
def daily_activity(spark, d):
    per = calendar.platform_minutes(table(spark, d, "events"), "ts", "event_type", "value")
    shown = F.array_join(F.transform(F.map_entries("activity"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return calendar.daily_activity(per).withColumn("activity", shown)


_CHANNELS = ", ".join(
    f"(sum(minutes * ('0x' || substr(color, {2 + 2 * i}, 2))::INT) // sum(minutes))::INT" for i in range(3)
)
_COLOR_CASE = "CASE platform " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_COLORS.items()) + " END"


@query("activity_calendar", f"""
WITH {SQL_CELLS},
blend AS (SELECT date, format('rgb({{}}, {{}}, {{}})', {_CHANNELS}) AS color
          FROM (SELECT *, {_COLOR_CASE} AS color FROM per) GROUP BY date),
shades AS (SELECT *, CASE WHEN total = 0 THEN 0.0 WHEN total < 30 THEN 0.35 WHEN total < 70 THEN 0.6
                          WHEN total < 130 THEN 0.8 ELSE 1.0 END::DOUBLE AS intensity FROM cells)
SELECT date, total, year, month, month_label, weekday, week_index, color, intensity,
       CASE WHEN n > 0 THEN 0.25 + intensity * 0.75 ELSE 1.0 END::DOUBLE AS opacity
FROM shades LEFT JOIN blend USING (date)""")
def activity_calendar(spark, d):
    return calendar.activity_calendar(
        table(spark, d, "events"), "ts", "event_type", "value", EVENT_COLORS
    ).drop("activity")


@query("user_heat", """
WITH u AS (SELECT user_id, ts::DATE AS date, sum(trunc(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2)
SELECT user_id, date, total, CASE WHEN total = 0 THEN 0.0 WHEN total < 30 THEN 0.35 WHEN total < 70 THEN 0.6
       WHEN total < 130 THEN 0.8 ELSE 1.0 END::DOUBLE AS intensity FROM u""")
def user_heat(spark, d):
    """Heat level per user and day."""
    totals = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.sum(F.col("value").cast("bigint")).alias("total")
    )
    from ..functions.numeric import intensity

    return totals.withColumn("intensity", intensity("total"))


@query("month_grids", f"""
WITH {SQL_CELLS},
grid AS (SELECT year, month, month_label, unnest(generate_series(0, max(week_index)))::INT AS week_index FROM cells
         GROUP BY year, month, month_label),
places AS (SELECT *, unnest(range(7))::INT AS weekday FROM grid)
SELECT p.year, p.month, p.month_label, p.week_index, p.weekday, c.date, c.total
FROM places p LEFT JOIN cells c USING (year, month, week_index, weekday)""")
def month_grids(spark, d):
    """Weeks of seven cells per month, unrolled again to one row per cell."""
    cells = calendar.activity_calendar(table(spark, d, "events"), "ts", "event_type", "value", EVENT_COLORS)
    weeks = calendar.month_grids(cells).select(
        "year", "month", "month_label", F.posexplode("weeks").alias("week_index", "week")
    )
    days = weeks.select("year", "month", "month_label", "week_index", F.posexplode("week").alias("weekday", "day"))
    return days.select("year", "month", "month_label", "week_index", "weekday", "day.date", "day.total")


@query("last_weeks", """
WITH m AS (SELECT max(ts::DATE) AS last FROM events)
SELECT unnest(generate_series(last - INTERVAL 370 DAY, last::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM m""")
def last_weeks(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("date"))
    return calendar.last_weeks(days)


@query("suffixed_values", """
SELECT DISTINCT p_name || e AS value FROM part, (SELECT unnest(['', '.txt', '.pdf', '.md']) AS e)""")
def suffixed_values(spark, d):
    from ..operators.lookup import suffixed_values as pairs

    return pairs(table(spark, d, "part"), "p_name", ["", ".txt", ".pdf", ".md"])


# Scaling and per-language correction of the complexity score.
TARGET_MEAN, TARGET_STD = 1.3385921716690063, 0.5742037296295166
CALIBRATION = (
    ("python", 1.0216596335395784, -0.0011651605738953242),
    ("java", 1.011004539238861, 0.011414428093364277),
    ("javascript", 1.034437906810602, -0.05396774061559057),
    ("php", 1.008464795463535, -0.015182837165158489),
    ("ruby", 0.9919257158956668, -0.07452748474750603),
    ("go", 1.0396476346221535, 0.035475594844279555),
)
_PAIRS = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in CALIBRATION)


@query("score_complexity", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 6 THEN 'cobol' ELSE {_NAMES} END AS language,
                  (l_quantity - 25.0) / 12.0 AS z FROM lineitem),
c(language, a, b) AS (VALUES {_PAIRS})
SELECT l_orderkey, l_linenumber, language,
       CASE WHEN c.a IS NOT NULL THEN round_even(exp(z * {TARGET_STD}::DOUBLE + {TARGET_MEAN}::DOUBLE) - 1, 2) END AS raw_complexity,
       round_even(exp((a * z + b) * {TARGET_STD}::DOUBLE + {TARGET_MEAN}::DOUBLE) - 1, 2) AS calibrated_complexity,
       CASE WHEN c.a IS NULL THEN 'Unknown language ''' || language || '''' END AS error
FROM r LEFT JOIN c USING (language)""")
def score_complexity(spark, d):
    """Stored scaling and correction applied to a given normalized score."""
    from ..operators.classify import score_complexity as score

    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_suppkey") % 7 == 6, "COBOL").otherwise(F.expr(_NAMES)).alias("language"),
        ((F.col("l_quantity") - 25.0) / 12.0).alias("z"),
    )
    corrections = spark.createDataFrame(list(CALIBRATION), "language STRING, a DOUBLE, b DOUBLE")
    scored = score(
        rows, F.lit(TARGET_MEAN), F.lit(TARGET_STD), corrections, code_metrics.LANGUAGE_IDS,
        lambda known: known.withColumn("prediction", F.col("z")),
    )
    return scored.drop("z").withColumn("language", F.lower("language"))
