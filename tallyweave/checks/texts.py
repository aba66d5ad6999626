"""Text, dates, JSON answers, keyword routing, retrieval and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave import vocab
from tallyweave.checks.registry import check, lines, plain_ts, r6
from tallyweave.functions import dates as d, jsons as js, text as tx
from tallyweave.operators import changes, filtering as fl, matching as mt
from tallyweave.operators.retrieval import search_documents
from tallyweave.plans import frontier, triage as tr
from tallyweave.session import work_path
from tallyweave.sources import catalogs, reports

_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(e):
    return rf"regexp_replace(regexp_replace({e}, '^{_WS}+', ''), '{_WS}+\z', '')"


def _docs(t):
    return t.table("documents")

# --- chunks and budgets ---------------------------------------------------------------------------

_RULE = r"(?s).{1,199}\z|.{1,200}[.\n]|.{200}"


@check("str01_chunk_text", f"""
    SELECT doc_id, len(c) AS chunks, md5(array_to_string(list_transform(c, lambda x: {_trim('x')}), '|')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(text, '{_RULE}') AS c FROM documents WHERE length(text) > 200) x
    UNION ALL SELECT doc_id, 1, md5(text) FROM documents WHERE length(text) <= 200""")
def _(t):
    chunks = _docs(t).select("doc_id", tx.chunk_text("text", 200).alias("c"))
    return chunks.select("doc_id", F.size("c").alias("chunks"), tx.content_hash(lines("c")).alias("digest"))


def _chunk_end(start):
    """End of a chunk of 500 from `start` by the last break inside its reach and beyond the overlap of 50."""
    head = f"substr(text, {start} + 2, 500)"
    last = lambda mark: f"CASE WHEN instr(reverse({head}), {mark}) > 0 THEN length({head}) - instr(reverse({head}), {mark}) ELSE -1 END"
    brk = f"greatest({last(repr('.'))}, {last('chr(10)')})"
    return f"CASE WHEN {start} + 500 > length(text) THEN length(text) WHEN {brk} + 2 > 50 THEN {start} + {brk} + 2 ELSE {start} + 500 END"


_NEXT = "(stop - 50)"


@check("str01_chunk_text_overlap", f"""
    WITH RECURSIVE walk AS (
        SELECT doc_id, text, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS start, CAST({_chunk_end('0')} AS BIGINT) AS stop
        FROM documents WHERE length(text) > 500
        UNION ALL SELECT doc_id, text, position + 1, {_NEXT}, CAST({_chunk_end(_NEXT)} AS BIGINT) FROM walk WHERE stop < length(text))
    SELECT doc_id, position, md5({_trim('substr(text, start + 1, stop - start)')}) AS chunk FROM walk
    UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 500""")
def _(t):
    chunks = _docs(t).select("doc_id", F.posexplode(tx.chunk_text("text", 500, 50)).alias("position", "chunk"))
    return chunks.withColumn("chunk", tx.content_hash("chunk"))


_BUDGET = 100


def _budget_round(source, chars=3):
    brk = "greatest(CASE WHEN instr(reverse(h), '.') > 0 THEN length(h) - instr(reverse(h), '.') ELSE -1 END, " \
          "CASE WHEN instr(reverse(h), chr(10)) > 0 THEN length(h) - instr(reverse(h), chr(10)) ELSE -1 END)"
    return f"""
        SELECT doc_id, CASE WHEN ex <= 0 THEN t WHEN goal < 140 THEN substr(t, 1, 140) WHEN length(c) = length(t) THEN substr(t, 1, goal)
                       ELSE c END AS t FROM (
            SELECT *, {_trim('substr(t, 1, CASE WHEN b > 0 THEN b + 1 ELSE goal END)')} AS c FROM (
                SELECT *, {brk} AS b FROM (SELECT *, CASE WHEN goal >= 140 THEN substr(t, 1, goal + 1) ELSE '' END AS h FROM (
                    SELECT *, CAST(length(t) - 3 * ex AS BIGINT) AS goal FROM (
                        SELECT *, CAST(ceil(length(t) / {chars}) - {_BUDGET} AS BIGINT) AS ex FROM ({source}) s) a) b1) b2) b3) b4"""


@check("str02_fit_budget", "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (" + _budget_round(_budget_round(_budget_round(
    "SELECT doc_id, text AS t FROM documents"))) + ") r")
def _(t):
    fitted = _docs(t).select("doc_id", tx.fit_budget("text", _BUDGET).alias("t"))
    return fitted.select("doc_id", F.length("t").alias("n"), tx.content_hash("t").alias("digest"))


_FOUR = "SELECT doc_id, text AS t FROM documents"
for _ in range(9):
    _FOUR = _budget_round(_FOUR, 4)


@check("str02_fit_budget_tokens", f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM ({_FOUR}) r")
def _(t):
    fitted = _docs(t).select("doc_id", tx.fit_budget("text", _BUDGET, lambda c: F.ceil(F.length(c) / 4)).alias("t"))
    return fitted.select("doc_id", F.length("t").alias("n"), tx.content_hash("t").alias("digest"))


# --- markup ---------------------------------------------------------------------------------------

_DECODE = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _e, _c in vocab.HTML_ENTITIES:
    _DECODE = f"replace({_DECODE}, '{_e}', '{_c if _c != chr(39) else chr(39) * 2}')"


@check("str03_strip_html", f"SELECT page_id, md5({_trim(_DECODE)}) AS digest FROM pages")
def _(t):
    return t.table("pages").select("page_id", tx.content_hash(tx.strip_html("html")).alias("digest"))


def _markup_sql(e):
    for pattern, into in [*vocab.MARKUP_REWRITES, vocab.INLINE_MATH, vocab.DISPLAY_MATH, vocab.CODE_BLOCK]:
        pattern, into = pattern.replace("\\n", "\n"), into.replace("$1", "\\1")
        e = f"regexp_replace({e}, '{pattern}', '{into}', 'g')"
    return f"'<div class=\"tutor-response\"><p>' || {e} || '</p></div>'"


_MARKED = "'**' || source || '** and *' || lang || '*' || chr(10) || chr(10) || text || ' $x$ $$y$$ ```' || chr(10) || source || '```'"


@check("str04_markdown_to_html", f"SELECT doc_id, md5({_markup_sql(_MARKED)}) AS digest FROM documents")
def _(t):
    c = F.concat(F.lit("**"), "source", F.lit("** and *"), "lang", F.lit("*\n\n"), "text", F.lit(" $x$ $$y$$ ```\n"), "source", F.lit("```"))
    return _docs(t).select("doc_id", tx.content_hash(tx.markdown_to_html(c)).alias("digest"))


@check("str05_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def _(t):
    return _docs(t).select("doc_id", tx.truncate("text", 80).alias("short"))


@check("str06_slugify", r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-\z', '', 'g')) AS slug FROM documents""")
def _(t):
    return _docs(t).select("doc_id", tx.content_hash(tx.slugify("text")).alias("slug"))


@check("str07_is_valid_email", r"""
    SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) x
    WHERE regexp_matches(w, '^[^\s@]+@[^\s@]+\.[^\s@]+\z') GROUP BY w""")
def _(t):
    words = _docs(t).select(F.explode(F.split("text", " ")).alias("w"))
    return words.where(tx.is_valid_email("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@check("str08_is_valid_currency", r"""
    SELECT doc_id, lang, lang IN ('en', 'es', 'fr', 'de', 'it', 'ja') AS language_ok,
           regexp_matches(upper(substr(source, 1, 3)), '^[A-Z]{3}\z') AS code_ok,
           upper(substr(source, 1, 3)) IN ('USD', 'EUR', 'GBP', 'CAD', 'AUD', 'JPY') AS currency_ok FROM documents""")
def _(t):
    code = F.upper(F.substring("source", 1, 3))
    return _docs(t).select("doc_id", "lang", tx.is_supported("lang", vocab.LANGUAGES).alias("language_ok"),
                           tx.is_valid_currency(code).alias("code_ok"),
                           tx.is_supported(code, list(vocab.CURRENCIES)).alias("currency_ok"))


@check("str09_password_strength", r"""
    SELECT doc_id, length(text) >= 8 AND regexp_matches(text, '[A-Z]') AND regexp_matches(text, '[a-z]') AND regexp_matches(text, '[0-9]')
           AND regexp_matches(text, '[^A-Za-z0-9]') AS strong FROM documents""")
def _(t):
    return _docs(t).select("doc_id", tx.is_strong_password("text").alias("strong"))


@check("str10_format_currency", """
    SELECT id, (CASE WHEN b < 0 THEN '-' ELSE '' END) || CASE id % 3 WHEN 0 THEN '$' || format('{:,.2f}', abs(b))
        WHEN 1 THEN '€' || format('{:,.2f}', abs(b)) ELSE '¥' || format('{:,.0f}', round(abs(b))) END AS money
    FROM (SELECT id, CAST(balance AS DOUBLE) - 3000 AS b FROM fx_accounts) a""")
def _(t):
    i = F.col("id")
    currency = F.when(i % 3 == 0, "USD").when(i % 3 == 1, "EUR").otherwise("JPY")
    return t.accounts.select("id", tx.format_currency(F.col("balance").cast("double") - 3000, currency).alias("money"))


@check("str10_format_number", r"""
    SELECT id, regexp_replace(format('{:,.3f}', CAST(balance AS DOUBLE)), '\.?0+\z', '') AS n FROM fx_accounts""")
def _(t):
    return t.accounts.select("id", tx.format_number("balance").alias("n"))

# --- answers --------------------------------------------------------------------------------------

_ANSWER = "'Complexity: ' || CASE doc_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'moderate' WHEN 2 THEN 'unclear' ELSE 'LOW' END || chr(10) || " \
          "CASE WHEN doc_id % 3 = 0 THEN 'Reasoning: ' || source || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'Message: ' ELSE '' END " \
          "|| replace(text, '. ', '.' || chr(10) || ' - ')"


def _answers(t):
    i = F.col("doc_id")
    level = F.when(i % 4 == 0, "High").when(i % 4 == 1, "moderate").when(i % 4 == 2, "unclear").otherwise("LOW")
    return _docs(t).select("doc_id", F.concat(
        F.lit("Complexity: "), level, F.lit("\n"), F.when(i % 3 == 0, F.concat(F.lit("Reasoning: "), "source", F.lit("\n"))).otherwise(""),
        F.when(i % 5 == 0, "Message: ").otherwise(""), F.replace("text", F.lit(". "), F.lit(".\n - "))).alias("answer"))


@check("str11_bullets", f"""
    SELECT doc_id, len(b) AS n, md5(array_to_string(list_transform(b, lambda x: {_trim('substr(x, 2)')}), '|')) AS digest FROM (
        SELECT doc_id, list_filter(list_transform(string_split(a, chr(10)), lambda x: {_trim('x')}), lambda x: starts_with(x, '-')) AS b
        FROM (SELECT doc_id, {_ANSWER} AS a FROM documents) s) s2""")
def _(t):
    found = _answers(t).select("doc_id", tx.bullets("answer").alias("b"))
    return found.select("doc_id", F.size("b").alias("n"), tx.content_hash(lines("b")).alias("digest"))


@check("str12_labelled_field", f"""
    SELECT doc_id, coalesce(nullif(lower(regexp_extract(a, '(?i)Complexity:\\s*(low|moderate|high)', 1)), ''), 'low') AS complexity,
           coalesce(nullif(regexp_extract(a, 'Reasoning:\\s*([^\\n]+)', 1), ''), '') AS reasoning,
           md5(coalesce(nullif(regexp_extract(a, 'Message:\\s*([^\\n]+)', 1), ''), a)) AS message
    FROM (SELECT doc_id, {_ANSWER} AS a FROM documents) s""")
def _(t):
    return _answers(t).select("doc_id", tx.labelled_field("answer", "complexity").alias("complexity"),
                              tx.labelled_field("answer", "reasoning").alias("reasoning"),
                              tx.content_hash(tx.labelled_field("answer", "message")).alias("message"))


def _any(e, words):
    return "(" + " OR ".join(f"contains(lower({e}), '{w}')" for w in words) + ")"


def _advice(t):
    i = F.col("doc_id")
    added = F.when(i % 5 == 0, " Urgent.").when(i % 5 == 1, " Continue.").when(i % 5 == 2, " ketoacidosis").otherwise("")
    return _docs(t).select("doc_id", F.concat("text", added).alias("text"))


_ADVICE = "(SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Urgent.' WHEN 1 THEN ' Continue.' WHEN 2 THEN ' ketoacidosis' ELSE '' END AS text FROM documents)"
_PRIORITY = f"CASE WHEN {_any('text', vocab.HIGH_PRIORITY_WORDS)} THEN 'high' WHEN {_any('text', vocab.LOW_PRIORITY_WORDS)} THEN 'low' ELSE 'medium' END"


@check("str13_priority", f"SELECT doc_id, {_PRIORITY} AS priority FROM {_ADVICE} a")
def _(t):
    return _advice(t).select("doc_id", tx.priority("text").alias("priority"))


@check("str14_escalate", f"SELECT doc_id, CASE WHEN {_any('text', vocab.CRITICAL_WORDS)} THEN 'high' ELSE {_PRIORITY} END AS priority FROM {_ADVICE} a")
def _(t):
    return _advice(t).select("doc_id", tx.escalate(tx.priority("text"), "text").alias("priority"))


@check("str15_complexity_to_priority", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority FROM documents""")
def _(t):
    i = F.col("doc_id")
    level = F.when(i % 3 == 0, "high").when(i % 3 == 1, "moderate").otherwise("low")
    return _docs(t).select("doc_id", tx.complexity_to_priority(level).alias("priority"))


_LOW_TERMS, _HIGH_TERMS = ["reing", "sich", "eaux"], ["ation", "anha"]


@check("str16_mention_notes", "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN contains(lower(text), '{w}') THEN '{note % w}' END" for w, note in
    [(w, vocab.LOW_IMPACT_NOTE) for w in _LOW_TERMS] + [(w, vocab.HIGH_IMPACT_NOTE) for w in _HIGH_TERMS]) + ") AS notes FROM documents")
def _(t):
    return _docs(t).select("doc_id", lines(tx.mention_notes("text", _LOW_TERMS, _HIGH_TERMS)).alias("notes"))


_NOTICE = f"CASE doc_id % 2 WHEN 0 THEN '{vocab.DISCLAIMERS[vocab.ROLES[0]]}' ELSE '{vocab.DISCLAIMERS[vocab.ROLES[1]]}' END"


@check("str17_add_disclaimer", f"""
    SELECT doc_id, md5(text || chr(10) || chr(10) || {_NOTICE}) AS message, source || '|' || {_NOTICE} AS recommendations FROM documents""")
def _(t):
    role = F.when(F.col("doc_id") % 2 == 0, vocab.ROLES[0]).otherwise(vocab.ROLES[1])
    return _docs(t).select("doc_id", tx.content_hash(tx.with_disclaimer("text", role)).alias("message"),
                           lines(tx.recommendations_with_disclaimer(F.array("source"), role)).alias("recommendations"))


@check("str18_enrich_text", f"""
    SELECT doc_id, md5(text || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || chr(10) || 'Patient Context:'
        || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'Age: ' || (doc_id % 90 + 1) END
        || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Diabetes Type: type ' || source ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Last Blood Sugar Reading: ' || (doc_id % 100 + 80) || ' mg/dL' ELSE '' END
        || chr(10) || 'Current Medications: ' || lang || ', ' || source END
        || chr(10) || chr(10) || 'Please provide advice from your perspective as a {vocab.ROLES[3]}.') AS digest FROM documents""")
def _(t):
    i = F.col("doc_id")
    context = F.when(i % 7 != 0, F.struct(
        F.when(i % 3 != 0, i % 90 + 1).alias("age"), F.when(i % 2 == 0, F.concat(F.lit("type "), "source")).alias("diabetes_type"),
        F.when(i % 5 == 0, i % 100 + 80).alias("last_blood_sugar"), F.array("lang", "source").alias("medications")))
    return _docs(t).select("doc_id", tx.content_hash(tx.enrich_text("text", context, F.lit(vocab.ROLES[3]))).alias("digest"))


@check("str23_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(t):
    return _docs(t).select("doc_id", tx.content_hash("text").alias("hash"))


@check("str24_split_list", f"""
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (
        SELECT doc_id, list_transform(string_split(text, ','), lambda x: {_trim('x')}) AS s FROM documents) x""")
def _(t):
    parts = _docs(t).select("doc_id", tx.split_list("text").alias("s"))
    return parts.select("doc_id", F.size("s").alias("n"), tx.content_hash(lines("s")).alias("digest"))


@check("str25_highlight", """
    SELECT doc_id, CASE WHEN p IS NOT NULL THEN substr(text, greatest(p - 30, 1), 30 + least(p - 1, 30) + 1) END AS snippet FROM (
        SELECT *, CASE WHEN a = 0 THEN nullif(b, 0) WHEN b = 0 THEN a ELSE least(a, b) END AS p FROM (
            SELECT doc_id, text, instr(lower(text), 'reing') AS a, instr(lower(text), 'sich') AS b FROM documents) x) y""")
def _(t):
    return _docs(t).select("doc_id", tx.highlight("text", ["Reing", "sich"], 30).alias("snippet"))

# --- dates ----------------------------------------------------------------------------------------

@check("dat03_format_date", "SELECT id, strftime(date, '%Y/%m/%d %B %b %A %a at %H:%M:%S') AS shown FROM fx_transactions")
def _(t):
    return t.transactions.select("id", d.format_date("date", "YYYY/MM/DD MMMM MMM dddd ddd at HH:mm:ss").alias("shown"))


@check("dat04_format_date_style", """
    SELECT id, strftime(date, '%-m/%-d/%y') AS short, strftime(date, '%b %-d, %Y') AS medium, strftime(date, '%B %-d, %Y') AS long,
           strftime(date, '%A, %B %-d, %Y') AS full FROM fx_transactions""")
def _(t):
    return t.transactions.select("id", *[d.format_date_style("date", s).alias(s) for s in vocab.DATE_STYLES])


@check("dat05_is_valid_date", "SELECT id, id % 3 <> 0 AS valid FROM fx_transactions")
def _(t):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("day "), F.col("date").cast("string"))).otherwise(F.col("date").cast("string"))
    return t.transactions.select("id", d.is_valid_date(text).alias("valid"))


@check("dat06_expand_reminders", """
    SELECT id, CAST(CAST(date + step AS DATE) AS VARCHAR) AS occurrence FROM (
        SELECT id, date, unnest(CASE id % 5 WHEN 0 THEN list_transform(range(1200), lambda k: CAST(k AS INTEGER) * INTERVAL '1' DAY)
            WHEN 1 THEN list_transform(range(400), lambda k: CAST(k AS INTEGER) * INTERVAL '7' DAY)
            WHEN 2 THEN list_transform(range(130), lambda k: CAST(k AS INTEGER) * INTERVAL '1' MONTH)
            WHEN 3 THEN list_transform(range(12), lambda k: CAST(k AS INTEGER) * INTERVAL '1' YEAR) ELSE [INTERVAL '0' DAY] END) AS step
        FROM fx_transactions WHERE date <= DATE '1997-03-31') x
    WHERE CAST(date + step AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""")
def _(t):
    i = F.col("id")
    repeat = F.when(i % 5 == 0, "daily").when(i % 5 == 1, "weekly").when(i % 5 == 2, "monthly").when(i % 5 == 3, "yearly")
    due = t.transactions.select("id", F.col("date").alias("due_date"), repeat.alias("repeat"))
    return d.expand_reminders(due, "1997-01-01", "1997-03-31").select("id", F.col("occurrence").cast("string").alias("occurrence"))

# --- JSON answers ---------------------------------------------------------------------------------

@check("jsn01_extract_tool_call", """
    SELECT event_id, event_id % 3 <> 0 AS found, CASE WHEN event_id % 3 = 1 THEN event_type END AS name,
           CASE WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 2 THEN 'PARSE_ERROR' END AS error
    FROM events""")
def _(t):
    i = F.col("event_id")
    body = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "parameters": '), "props", F.when(i % 3 == 2, "").otherwise("}"))
    answer = F.when(i % 3 == 0, F.lit("plain answer")).otherwise(F.concat(F.lit("I will\n[SKILL_START]\n"), body, F.lit("\n[SKILL_END]\ndone")))
    call = t.table("events").select("event_id", js.extract_tool_call(answer).alias("c"))
    return call.select("event_id", F.col("c").isNotNull().alias("found"), "c.name",
                       F.get_json_object("c.parameters", "$.k").alias("k"), "c.error")


@check("jsn02_parse_command", """
    SELECT id, CASE WHEN intent = 'unknown' THEN 'unknown' ELSE intent END AS intent, round(execution_ms / 1000, 6) AS confidence,
           CAST(user_id AS VARCHAR) AS account FROM fx_commands""")
def _(t):
    intent = F.when(F.col("intent") == "unknown", "order_pizza").otherwise(F.col("intent"))
    text = F.to_json(F.struct(intent.alias("intent"), (F.col("execution_ms") / 1000).alias("confidence"),
                              F.create_map(F.lit("accountId"), F.col("user_id").cast("string")).alias("entities")))
    parsed = t.commands.select("id", js.parse_command(text).alias("c"))
    return parsed.select("id", "c.intent", r6("c.confidence").alias("confidence"), F.col("c.entities")["accountId"].alias("account"))


@check("jsn03_tool_references", """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url || '|' || url || '#2' END AS urls FROM pages""")
def _(t):
    i = F.col("page_id")
    hits = F.to_json(F.array(F.struct(F.col("url")), F.struct(F.lit("").alias("url")), F.struct(F.concat("url", F.lit("#2")).alias("url"))))
    call = lambda tool, error: F.struct(tool.alias("toolName"), hits.alias("result"), error.alias("error"))
    calls = F.to_json(F.array(call(F.lit("wikipedia"), F.when(i % 4 == 0, "timeout")), call(F.lit("calculator"), F.lit(None).cast("string"))))
    return t.table("pages").select("page_id", lines(js.tool_references(calls)).alias("urls"))


@check("jsn04_command_envelope", """
    SELECT id, status, status = 'completed' AS success, CASE WHEN status <> 'completed' THEN 'COMMAND_PROCESSING_ERROR' END AS code FROM fx_commands""")
def _(t):
    error = F.when(F.col("status") == "failed", "ledger is closed").when(F.col("status") == "requires_clarification", "needs clarification: which account?")
    return t.commands.select("id", js.command_envelope(error).alias("e")).select("id", "e.status", "e.success", "e.code")

# --- arrays and sets ------------------------------------------------------------------------------

_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@check("arr01_flat_map", f"SELECT doc_id, md5(x) AS item, count(*) AS n FROM (SELECT doc_id, unnest({_LINES}) AS x FROM documents) s GROUP BY 1, 2")
def _(t):
    items = _docs(t).select("doc_id", F.explode(tx.compact(F.split("text", "\n"))).alias("x"))
    return items.groupBy("doc_id", tx.content_hash("x").alias("item")).agg(F.count(F.lit(1)).alias("n"))


@check("arr02_join_lines", "SELECT doc_id, md5(array_to_string(string_split(text, '. '), chr(10))) AS digest FROM documents")
def _(t):
    return _docs(t).select("doc_id", tx.content_hash(tx.join_lines(F.split("text", r"\. "))).alias("digest"))


@check("arr03_numbered_list", f"""
    SELECT doc_id, md5(array_to_string(list_transform(l, lambda x, i: i || '. ' || x), chr(10))) AS digest
    FROM (SELECT doc_id, {_LINES} AS l FROM documents) s""")
def _(t):
    return _docs(t).select("doc_id", tx.content_hash(tx.numbered_list(tx.compact(F.split("text", "\n")))).alias("digest"))


@check("fil08_compact", "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS text FROM documents) d WHERE text <> ''")
def _(t):
    holed = _docs(t).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 > 1, F.col("text")).alias("text"))
    return fl.compact(holed, "text").select("doc_id")


@check("agg22_distinct_items", "SELECT DISTINCT source AS run, md5(text) AS item FROM documents")
def _(t):
    return _docs(t).select(F.col("source").alias("run"), tx.content_hash("text").alias("item")).dropDuplicates(["run", "item"])


@check("set02_append_insights", "SELECT item, count(*) AS n FROM (SELECT md5(text) AS item FROM documents UNION ALL SELECT md5(text) FROM benchmark) x GROUP BY item")
def _(t):
    both = _docs(t).select("text").unionByName(t.table("benchmark").select("text"))
    return both.groupBy(tx.content_hash("text").alias("item")).agg(F.count(F.lit(1)).alias("n"))


@check("set03_union_distinct", "SELECT md5(text) AS item FROM documents UNION SELECT md5(text) FROM benchmark")
def _(t):
    both = _docs(t).select(tx.content_hash("text").alias("item")).union(t.table("benchmark").select(tx.content_hash("text")))
    return both.distinct()


@check("joi14_uncached_texts", """
    SELECT DISTINCT md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src1')""")
def _(t):
    cache = _docs(t).where("source = 'src1'").select(tx.content_hash("text").alias("hash"))
    return changes.uncached_texts(_docs(t), cache).select("hash")

# --- lookups and routing --------------------------------------------------------------------------

# The prose of the test tables is invented, so the lookup lists are made of its frequent syllables.
_LOOKUP = [
    dict(keywords=["reing", "thsh"], covered=True, coverage=80, approval=90, referral=None, annual_limit=None, category="treatment", notes="first"),
    dict(keywords=["sich", "nicht"], covered=True, coverage=70, approval=None, referral=True, annual_limit=None, category="specialist", notes="second"),
    dict(keywords=["eaux", "ench"], covered=True, coverage=65, approval=88, referral=None, annual_limit=20, category="therapy", notes="third"),
    dict(keywords=["ation"], covered=False, coverage=85, approval=85, referral=None, annual_limit=None, category="diagnostic", notes="fourth"),
    dict(keywords=["ciónme"], covered=True, coverage=90, approval=61, referral=None, annual_limit=None, category="treatment", notes="fifth"),
]
_ROUTING = {
    "exercise": (3, ["reing", "edtion", "thsh"]), "nutrition": (3, ["eaux", "sich", "atble"]),
    "lifestyle": (2, ["anha", "haen", "ench"]), "medical": (5, ["ining", "ernt", "den"]),
}


def _hit(row):
    return _any("text", row["keywords"])


@check("joi09_match_keywords", " UNION ALL ".join(
    f"SELECT doc_id, {i} AS pos, '{row['category']}' AS category FROM documents WHERE {_hit(row)}" for i, row in enumerate(_LOOKUP)))
def _(t):
    return mt.match_keywords(_docs(t), "text", _LOOKUP).select("doc_id", "entry.pos", "entry.category")


# ten pieces of every document's text are the lookup table: at least ten times as many rows as documents
_PIECES = 10


@check("joi09_match_keyword_table", f"""
    WITH k AS (SELECT 10 * doc_id + i AS pos, lower(substr(text, 3 + 9 * CAST(i AS INTEGER), 7)) AS word
               FROM documents, range({_PIECES}) r(i) WHERE length(text) >= 100),
    s AS (SELECT DISTINCT doc_id, substr(lower(text), CAST(j AS INTEGER), 7) AS word FROM (
        SELECT doc_id, text, unnest(range(1, length(text) - 5)) AS j FROM documents) p)
    SELECT doc_id, count(*) AS entries, CAST(sum(pos) AS BIGINT) AS places, min(pos) AS first
    FROM s JOIN k USING (word) GROUP BY doc_id""")
def _(t):
    docs = _docs(t)
    lookup = docs.where(F.length("text") >= 100).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(_PIECES - 1))).alias("i")).select(
        (10 * F.col("doc_id") + F.col("i")).alias("pos"),
        F.array(F.lower(F.substr("text", 3 + 9 * F.col("i"), F.lit(7)))).alias("keywords"))
    # entries with the same keyword are one class, so a text gives one row per class and not one per entry
    classes = lookup.groupBy("keywords").agg(F.count(F.lit(1)).alias("entries"), F.sum("pos").alias("places"), F.min("pos").alias("pos"))
    found = mt.match_keyword_table(docs.select("doc_id", "text"), "text", classes)
    return found.groupBy("doc_id").agg(F.sum("entry.entries").alias("entries"), F.sum("entry.places").alias("places"),
                                       F.min("entry.pos").alias("first"))


def _best_sql(column, default):
    scored = sorted(enumerate(_LOOKUP), key=lambda p: (-(p[1]["coverage"] + (p[1]["approval"] or 0)) / 2, p[0]))
    return "CASE " + " ".join(f"WHEN {_hit(row)} THEN {column(row)}" for _, row in scored) + f" ELSE {default} END"


@check("top05_best_coverage", f"SELECT doc_id, {_best_sql(lambda r: repr(r['notes']), 'NULL')} AS notes, {_best_sql(lambda r: r['coverage'], 0)} AS coverage FROM documents")
def _(t):
    best = _docs(t).select("doc_id", mt.best_coverage("text", _LOOKUP).alias("b"))
    return best.select("doc_id", "b.notes", F.coalesce("b.coverage", F.lit(0)).alias("coverage"))


_RATES = mt.category_rates(_LOOKUP)
_COVER_SQL = {
    "covered": _best_sql(lambda r: str(r["covered"]).lower(), "false"), "estimate": _best_sql(lambda r: r["coverage"], 0),
    "notes": _best_sql(lambda r: "'" + r["notes"] + (vocab.REFERRAL_SUFFIX if r["referral"] else "") + "'", f"'{vocab.NO_COVERAGE_NOTE}'"),
    "approval_rate": _best_sql(lambda r: f"CAST({_RATES[r['category']]} AS DOUBLE)", "CAST(0 AS DOUBLE)"),
    "requires_preauth": _best_sql(lambda r: str(r["category"] == "diagnostic" or bool(r["referral"])).lower(), "NULL"),
}


def _cover(c):
    return [F.col(f"{c}.covered").alias("covered"), F.col(f"{c}.coverage").alias("estimate"), F.col(f"{c}.notes").alias("notes"),
            F.col(f"{c}.approval_rate").alias("approval_rate"), F.col(f"{c}.requires_preauth").alias("requires_preauth")]


@check("job08_coverage_flags", "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _COVER_SQL.items()) + " FROM documents")
def _(t):
    # The remaining-limit flag is a hash of the engine and is covered by a test.
    return _docs(t).select("doc_id", mt.coverage("text", _LOOKUP).alias("c")).select("doc_id", *_cover("c"))


@check("agg17_approval_rate_by_category", """
    SELECT p_type AS category, round(avg(CASE WHEN p_size >= 10 THEN p_size ELSE 0 END), 6) AS approval_rate FROM part GROUP BY p_type""")
def _(t):
    lookup = t.table("part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") >= 10, F.col("p_size")).alias("approval"))
    return mt.approval_rate_by_category(lookup).withColumn("approval_rate", r6("approval_rate"))


def _score_sql(role, primary):
    words = role.lower().split(" ")
    parts = [f"CASE WHEN {_any('text', _ROUTING['medical'][1])} THEN 10 ELSE 0 END"] if primary else []
    parts.append(f"CASE WHEN {_any('text', words)} THEN 5 ELSE 0 END")
    for category, (weight, terms) in _ROUTING.items():
        if any(category in w for w in words):
            parts += [f"CASE WHEN contains(lower(text), '{w}') THEN {weight} ELSE 0 END" for w in terms]
    return " + ".join(parts)


_SCORES = " UNION ALL ".join(f"SELECT doc_id, text, {i} AS pos, '{role}' AS role, {_score_sql(role, i == 0)} AS score FROM documents"
                             for i, role in enumerate(vocab.ROLES))


@check("sco01_routing_score", f"SELECT doc_id, role, score FROM ({_SCORES}) s")
def _(t):
    scored = _docs(t).select("doc_id", F.explode(mt.routing_scores("text", keywords=_ROUTING)).alias("s"))
    return scored.select("doc_id", "s.role", "s.score")


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM ({_SCORES}) s"


@check("top06_route_topk", f"SELECT doc_id, place, role, score FROM ({_RANKED}) r WHERE place <= 2")
def _(t):
    top = _docs(t).select("doc_id", F.posexplode(mt.route_topk("text", 2, keywords=_ROUTING)).alias("p", "s"))
    return top.select("doc_id", (F.col("p") + 1).alias("place"), "s.role", "s.score")


_LEVEL = "CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END"
_TRIAGED = f"""
    SELECT doc_id, role, CASE WHEN doc_id % 3 = 2 THEN pos ELSE place - 1 END AS consulted, {_PRIORITY} AS priority,
           {_COVER_SQL['estimate']} AS estimate, {_COVER_SQL['notes']} AS notes
    FROM (SELECT r.doc_id, r.role, r.pos, r.place, a.text FROM ({_RANKED}) r JOIN {_ADVICE} a ON a.doc_id = r.doc_id) x
    WHERE place <= CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END"""


def _triaged(t):
    i = F.col("doc_id")
    level = F.when(i % 3 == 0, "low").when(i % 3 == 1, "moderate").otherwise("high")
    added = F.when(i % 5 == 0, " Urgent.").when(i % 5 == 1, " Continue.").when(i % 5 == 2, " ketoacidosis").otherwise("")
    asked = _docs(t).select("doc_id", "text", level.alias("complexity"), F.concat("text", added).alias("answer"))
    return tr.triage(asked, "text", "complexity", "answer", _LOOKUP, keywords=_ROUTING)


@check("job07_triage", _TRIAGED)
def _(t):
    return _triaged(t).select("doc_id", "role", "consulted", "priority", F.col("coverage.coverage").alias("estimate"), "coverage.notes")


@check("top07_order_by_priority", f"""
    SELECT doc_id, role, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS priority_order FROM ({_TRIAGED}) t
    ORDER BY priority_order DESC, consulted""")
def _(t):
    return tr.order_by_priority(_triaged(t)).select("doc_id", "role", "priority_order")

# --- retrieval, fan-out, reports ------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@check("joi17_search_documents", f"""
    WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS word FROM benchmark),
    w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
    f AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY doc_id, word),
    s AS (SELECT word, count(*) AS df FROM f GROUP BY word),
    r AS (SELECT query_id, doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score
          FROM q JOIN f USING (word) JOIN s USING (word) GROUP BY query_id, doc_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM r) p WHERE position <= 5""")
def _(t):
    queries = t.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_documents(queries, _docs(t), 5)


@check("joi17_search_repeated_ids", f"""
    WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS word FROM benchmark),
    w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
    f AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY doc_id, word),
    s AS (SELECT word, count(*) AS df FROM f GROUP BY word),
    r AS (SELECT query_id, doc_id // 3 AS doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score
          FROM q JOIN f USING (word) JOIN s USING (word) GROUP BY query_id, doc_id // 3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM r) p WHERE position <= 5""")
def _(t):
    queries = t.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_documents(queries, _docs(t).withColumn("doc_id", F.expr("doc_id div 3")), 5)


@check("job06_expand_frontier", """
    WITH e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, dst) AS place FROM fx_edges GROUP BY src, dst),
    l1 AS (SELECT DISTINCT src AS seed, dst AS node FROM e WHERE place <= 3 AND src LIKE 'S%'),
    l2 AS (SELECT DISTINCT seed, dst AS node FROM l1 JOIN e ON src = node AND place <= 2),
    l3 AS (SELECT DISTINCT seed, dst AS node FROM l2 JOIN e ON src = node AND place <= 1)
    SELECT seed, node, min(level) AS level FROM (
        SELECT *, 1 AS level FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) x GROUP BY seed, node""")
def _(t):
    seeds = t.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seed")).distinct()
    return frontier.expand_frontier(seeds, t.edges, 3, 3)


def _findings(t):
    docs = _docs(t).select(F.col("lang").alias("query_id"), F.format_string("finding %d of %s", "doc_id", "source").alias("insight"))
    urls = t.table("pages").select(F.regexp_extract("url", r"/(\w\w)/", 1).alias("query_id"), "url").where("query_id <> ''")
    return docs, urls.where(F.col("query_id").isin("en", "fr", "de", "es"))


_REPORT = r"""
    WITH i AS (SELECT lang AS query_id, string_agg('<insight>' || chr(10) || x || chr(10) || '</insight>', chr(10) ORDER BY x) AS body FROM (
            SELECT lang, 'finding ' || doc_id || ' of ' || source AS x FROM documents) d GROUP BY lang),
    s AS (SELECT q AS query_id, string_agg('- ' || url, chr(10) ORDER BY url) AS body FROM (
            SELECT regexp_extract(url, '/(\w\w)/', 1) AS q, url FROM pages) p WHERE q IN ('en', 'fr', 'de', 'es') GROUP BY q)
    SELECT query_id, 0 AS page, md5(i.body || chr(10) || chr(10) || '## Reference Sources' || chr(10) || chr(10) || s.body) AS digest FROM i JOIN s USING (query_id)"""


@check("src14_compile_report", _REPORT)
def _(t):
    insights, sources = _findings(t)
    return reports.whole_digests(reports.compile_report(insights, sources))


@check("src14_write_reports", _REPORT)
def _(t):
    insights, sources = _findings(t)
    root = work_path(t.spark, "reports")
    reports.write_reports(reports.compile_report(insights, sources), root)
    text = t.spark.read.schema("value string, query_id string, page bigint").text(root, wholetext=True)
    return reports.whole_digests(text.select("query_id", "page", F.regexp_replace("value", r"\n\z", "").alias("text")))


@check("src05_read_alpha_catalog", """
    SELECT o_orderpriority AS frequency, 'delta(close,' || count(*) || ')' AS alpha FROM orders GROUP BY o_orderpriority""")
def _(t):
    root = work_path(t.spark, "catalog")
    rows = t.table("orders").groupBy(F.col("o_orderpriority").alias("frequency")).agg(
        F.concat(F.lit("delta(close,"), F.count(F.lit(1)), F.lit(")")).alias("alpha"))
    catalogs.write_catalog(rows, root)
    return catalogs.read_alpha_catalog(t.spark, root, multi_line=False)
