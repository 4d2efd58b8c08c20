"""The SQL of the queries that SQL can express, for an independent check."""

from __future__ import annotations

from paperlode import config
from paperlode.functions.text import BLANKS

QUERY_STEP = 50


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _plain_tokens(x: str) -> str:
    grams = (
        "CASE WHEN length(r) <= 2 THEN [r] ELSE list_concat(list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), "
        "list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3))), CASE WHEN length(r) <= 8 THEN [r] ELSE [] END) END"
    )
    norm = f"replace(lower({x}), '　', ' ')"
    return f"list_concat(regexp_extract_all({norm}, '{config.LATIN_NUMBER}'), flatten(list_transform(regexp_extract_all({norm}, '{config.CJK_RUN}'), lambda r: {grams})))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _matches(x: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{pattern}')"


def _low(x: str) -> str:
    return f"replace(lower({x}), '　', ' ')"


def _structured(x: str) -> str:
    found = f"list_transform({_matches(x, config.STRUCTURED)}, lambda s: {_strip('s')})"
    return f"list_transform([{found}], lambda f: {_distinct('f')})[1]"


def _tokens(x: str) -> str:
    """The bag of terms of a text. Words of one or two digits are told by the runs of letters and digits around them."""
    alias = config.DOC_ALIAS[: config.DOC_ALIAS.index("|(?<!")]
    numbers = r"list_filter(regexp_extract_all(w, '[\p{L}\p{N}_]+'), lambda n: regexp_full_match(n, '\d{1,2}'))"
    parts = [_matches("w", config.STRUCTURED), _matches("w", config.ENTITY), f"list_filter({_list(config.FINANCE_TERMS)}, lambda t: contains(w, lower(t)))", _matches("w", alias), numbers, _plain_tokens("w")]
    return f"list_filter(list_transform([{_low(f'coalesce({x}, {EMPTY})')}], lambda w: flatten([{', '.join(parts)}]))[1], lambda t: trim(t) <> '')"


def _metrics(x: str) -> str:
    return f"list_filter({_list(config.METRIC_TERMS)}, lambda t: contains(lower(coalesce({x}, '')), lower(t)))"


def _numbers(x: str) -> str:
    return rf"list_transform({_matches(x, config.NUMBER)}, lambda t: regexp_replace(t, '\s+', '', 'g'))"


def _once(x: str) -> str:
    return f"list_transform([{x}], lambda f: {_distinct('f')})[1]"


def _hints(x: str) -> str:
    return _once(f"list_transform({_matches(x, config.DOC_HINT)}, lambda h: regexp_replace(lower(h), '^fc_(text)', '\\1'))")


def _important(x: str) -> str:
    generic = f"list_filter({_matches(x, config.GENERIC)}, lambda t: length(t) >= 2 AND NOT list_contains({_list(config.STOP_WORDS)}, t))"
    return _once(f"flatten([{_metrics(x)}, {_numbers(x)}, {_once(_matches(x, config.STRONG))}, {generic}])") + "[1:80]"


EMPTY = "''"
DOCS = "docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM filings WHERE doc_id IS NOT NULL)"
CHUNKS = "corpus AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)"
QUESTIONS = "asks AS (SELECT DISTINCT ON (qid) * FROM questions WHERE qid IS NOT NULL)"
ANSWERS = "replies AS (SELECT DISTINCT ON (answer_id) * FROM answers WHERE answer_id IS NOT NULL)"
BAGS = f"bags AS (SELECT chunk_id, doc_id, domain, {_plain_tokens("concat_ws(' ', title, array_to_string(keywords, ' '), text)")} AS tokens FROM corpus)"
OPTIONS = "coalesce(array_to_string(list_sort(list_transform(map_entries(options), lambda e: upper(e.key) || '. ' || coalesce(e.value, ''))), chr(10)), '')"
QUERY_TEXT = f"concat_ws(chr(10), coalesce(question, ''), {OPTIONS}, coalesce(type, ''), coalesce(array_to_string(doc_ids, ' '), ''))"
KEYS = "coalesce(list_sort(list_transform(map_keys(options), lambda k: upper(k))), [])"


def _letters(answer: str, judged: str) -> str:
    keys = KEYS
    allowed = f"CASE WHEN len({keys}) = 0 THEN ['A', 'B', 'C', 'D'] ELSE {keys} END"
    letters = f"list_filter(regexp_extract_all(upper(coalesce({answer}, '')), '[ABCD]'), lambda c: list_contains({allowed}, c))"
    form = "coalesce(answer_format, 'multi')"
    true = f"list_filter({keys}, lambda k: coalesce({judged}[k], false))"
    return f"""CASE WHEN len({letters}) > 0 AND {form} IN ('mcq', 'tf') THEN {letters}[1]
        WHEN len({letters}) > 0 THEN array_to_string(list_sort(list_distinct({letters})), '')
        WHEN {form} = 'multi' AND len({true}) > 0 THEN array_to_string({true}, '')
        WHEN {form} IN ('mcq', 'tf') AND len({true}) > 0 THEN {true}[1]
        WHEN {form} = 'tf' AND list_contains({keys}, 'A') THEN 'A'
        ELSE coalesce({keys}[1], 'A') END"""


SCORED = f"""{QUESTIONS},
    last AS (SELECT * FROM answers WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY answered_at DESC NULLS LAST, answer_id DESC, ingested_at DESC NULLS LAST) = 1),
    scored AS (SELECT asks.qid, asks.domain, asks.answer_format, asks.type, asks.answer AS gold, last.qid IS NULL AS was_missing,
        {_letters("last.answer", "last.option_judgements")} AS pred
        FROM asks LEFT JOIN last ON asks.qid = last.qid WHERE asks.answer IS NOT NULL)"""
_QTEXT = "concat_ws(chr(10), coalesce(question, ''), coalesce(array_to_string(map_values(options), chr(10)), ''), coalesce(type, ''))"
_FTEXT = "concat_ws(chr(10), coalesce(question, ''), coalesce(array_to_string(map_values(options), ' '), ''))"
KINDS = f"""kinds AS (SELECT *, CASE WHEN calc THEN 'calculation' WHEN comp THEN 'comparison' WHEN coalesce(answer_format, '') = 'tf' OR judge THEN 'judgement' ELSE 'fact_lookup' END AS kind
    FROM (SELECT *, regexp_matches(qtext, '{config.COMPARES}') AS comp, regexp_matches(qtext, '{config.JUDGES}') AS judge,
        regexp_matches(qtext, '{config.CALCULATES}') OR (n >= 2 AND coalesce(domain, '') = 'financial_reports') AS calc
        FROM (SELECT *, {_QTEXT} AS qtext, {_FTEXT} AS ftext, coalesce(len(list_filter(map_values(options), lambda v: regexp_matches(v, '{config.NUMERIC_OPTION}'))), 0) AS n FROM asks)))"""
RUNS = f"""{QUESTIONS}, {KINDS},
    last AS (SELECT * FROM answers WHERE qid IS NOT NULL AND run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, qid ORDER BY answered_at DESC NULLS LAST, answer_id DESC, ingested_at DESC NULLS LAST) = 1),
    runs AS (SELECT last.answer_id, last.run_id, last.qid, last.error, coalesce(len(last.used_doc_ids), 0) AS evidence, kinds.domain, kinds.kind, kinds.answer AS gold,
        coalesce(last.token_usage.total_tokens, 0) AS tokens,
        {_letters("last.answer", "last.option_judgements")} AS pred FROM last JOIN kinds ON last.qid = kinds.qid)"""
DIAGNOSED = f"""{QUESTIONS}, {KINDS},
    last AS (SELECT * FROM answers WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY answered_at DESC NULLS LAST, answer_id DESC, ingested_at DESC NULLS LAST) = 1),
    diagnosed AS (SELECT kinds.qid, kinds.domain, kinds.answer_format, kinds.kind, kinds.calc, coalesce(last.error, '') <> '' AS failed, coalesce(len(last.used_doc_ids), 0)::BIGINT AS evidence,
        CASE WHEN kinds.answer IS NOT NULL THEN {_letters("kinds.answer", "MAP([]::VARCHAR[], []::BOOLEAN[])")} END AS gold,
        {_letters("last.answer", "MAP([]::VARCHAR[], []::BOOLEAN[])")} AS pred
        FROM kinds LEFT JOIN last ON kinds.qid = last.qid)"""
WANTED = f"wanted AS (SELECT qid AS query_id, {QUERY_TEXT} AS query, coalesce(domain, '') AS domain, coalesce(doc_ids, []) AS scope FROM asks)"
WANTED_DOCS = rf"""wanted AS (SELECT qid AS query_id, {QUERY_TEXT} AS query, coalesce(domain, '') AS domain, []::VARCHAR[] AS scope FROM asks
    WHERE regexp_extract(qid, '(\d+)$', 1)::BIGINT % {QUERY_STEP} = 0)"""
ALIASES = r"""list_distinct(flatten([[lower(doc_id)], CASE WHEN starts_with(lower(doc_id), 'text') THEN ['fc_' || lower(doc_id)] ELSE [] END,
    CASE WHEN starts_with(lower(doc_id), 'pack2_text') THEN [substr(lower(doc_id), 7)] ELSE [] END,
    CASE WHEN starts_with(lower(doc_id), 'annual_') AND len(string_split(lower(doc_id), '_')) >= 3 THEN string_split(lower(doc_id), '_')[2:3] ELSE [] END]))"""


def _ranked_chunks(k: int) -> str:
    """Every chunk in a query's scope and domain with its score, from the formulas, without any bounds; the k best. Queries
    without a scope rank chunks that share a term and those of documents that they name."""
    return f"""bags AS (SELECT chunk_id, {_tokens("concat_ws(' ', title, array_to_string(keywords, ' '), text)")} AS tokens FROM corpus),
        asked AS (SELECT *, {_low("query")} AS low, {_structured("query")} AS structured, {_tokens("query")} AS tokens FROM wanted),
        sets AS (SELECT *, list_filter({_once("list_concat(structured, tokens)")}, lambda t: length(t) >= 2) AS terms FROM asked),
        qterms AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(tokens) AS term FROM asked) GROUP BY ALL),
        posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM bags) WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM posts GROUP BY term), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM bags),
        bm AS (SELECT query_id, posts.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * least(qf, 3) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len(bags.tokens), 1) / avgdl))) AS bm25
            FROM qterms JOIN posts USING (term) JOIN df USING (term) JOIN bags ON bags.chunk_id = posts.chunk_id CROSS JOIN stats GROUP BY 1, 2),
        pairs AS (SELECT sets.query_id, low, structured, scope, c.chunk_id, c.doc_id, c.title, coalesce(bm25, 0) AS bm25,
                list_filter(terms, lambda t: contains({_low("concat_ws(' ', c.title, c.text)")}, {_low("t")}))[1:30] AS matched
            FROM sets JOIN corpus c ON (sets.domain = '' OR sets.domain = c.domain) AND (len(scope) = 0 OR list_contains(scope, c.doc_id))
            LEFT JOIN bm ON bm.query_id = sets.query_id AND bm.chunk_id = c.chunk_id
            WHERE len(scope) > 0 OR bm25 > 0 OR len(list_filter({ALIASES.replace("doc_id", "c.doc_id")}, lambda a: contains(low, a))) > 0 OR c.title <> '' AND contains(low, {_low("c.title")})),
        scores AS (SELECT query_id, chunk_id, doc_id, matched, round(bm25 + coalesce(CASE WHEN contains(low, doc_id) THEN 2.0 ELSE 0 END, 0) + 1.5 * len(list_filter({ALIASES}, lambda a: contains(low, a)))
                + CASE WHEN title <> '' AND contains(low, {_low("title")}) THEN 1.5 ELSE 0 END + CASE WHEN list_contains(scope, doc_id) THEN 1.0 ELSE 0 END
                + least(4.0, 0.8 * len(list_filter(structured, lambda t: list_contains(matched, t)))) + least(2.0, 0.08 * len(matched)), 6) AS score FROM pairs),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM scores WHERE score > 0 QUALIFY rank <= {k})"""


def _yes(j: str) -> str:
    return f"coalesce(({j})::VARCHAR NOT IN ('false', 'null', '0', '0.0', '\"\"', '[]', '{{}}'), false)"


def _said(path: str) -> str:
    return f"""CASE json_type(v, '{path}') WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract(v, '{path}[*]'), lambda x: x->>'$'), '')
        WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL ELSE json_extract_string(v, '{path}') END"""


def _letter_keys(path: str) -> str:
    keys = f"list_filter(list_sort(json_keys(v, '{path}')), lambda k: upper(k) IN ('A', 'B', 'C', 'D') AND {_yes(f"""json_extract(json_extract(v, '{path}'), '$.' || k)""")})"
    return f"CASE WHEN json_type(v, '{path}') = 'OBJECT' AND len({keys}) > 0 THEN array_to_string({keys}, '') END"


REPLY_NAMES = ("answer", "value", "choice", "choices", "letters")
PARSED = rf"""bodies AS (SELECT replies.answer_id, replies.raw_model_output AS raw, asks.answer_format, asks.options, regexp_replace(trim(raw_model_output), '^```(?:json)?\s*|\s*```$', '', 'g') AS body,
        regexp_extract(raw_model_output, '(?s)\{{.*\}}', 0) AS braces FROM replies JOIN asks ON replies.qid = asks.qid),
    vs AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON WHEN json_valid(braces) THEN braces::JSON END AS v FROM bodies),
    js AS (SELECT *, coalesce({", ".join(f"CASE WHEN {_yes(f"json_extract(v, '$.{k}')")} THEN json_extract(v, '$.{k}') END" for k in ("option_judgements", "judgements", "opt"))}) AS j FROM vs),
    es AS (SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN list_transform(list_sort(json_keys(j)), lambda k: {{'o': upper(k), 'v': json_extract(j, '$.' || k)}})
        WHEN 'ARRAY' THEN list_transform(json_extract(j, '$[*]'), lambda x: {{'o': upper(coalesce(x->>'option', x->>'key', x->>'letter')), 'v': x}}) ELSE [] END AS ents FROM js),
    ms AS (SELECT *, map_from_entries(list_transform(list_filter(['A', 'B', 'C', 'D'], lambda l: len(list_filter(ents, lambda e: e.o = l)) > 0),
        lambda l: {{'k': l, 'v': list_transform([list_filter(ents, lambda e: e.o = l)[-1].v], lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN {_yes("coalesce(json_extract(x, '$.verdict'), json_extract(x, '$.v'))")} ELSE {_yes("x")} END)[1]}})) AS judged,
        coalesce({", ".join([_said("$.answer"), *(_said(f"$.answer.{k}") for k in REPLY_NAMES), _letter_keys("$.answer"), *(_said(f"$.{k}") for k in REPLY_NAMES[1:]), _letter_keys("$")])},
            nullif(regexp_extract(raw, '(?i)"answer"\s*:\s*"([A-D]+)"', 1), ''), nullif(regexp_extract(raw, '(?i)(?:答案|answer)\s*[:：]?\s*([A-D]{{1,4}})', 1), ''), raw, '') AS said FROM es)"""
PROFILES = f"""profiles AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest(list_concat({_tokens("concat_ws(' ', doc_id, title, array_to_string(keywords, ' '))")}, {_structured("text")})) AS term FROM corpus) GROUP BY ALL)"""


SQL: dict[str, str] = {
    "doc_profiles": f"WITH {CHUNKS}, {PROFILES} SELECT doc_id, term, cnt FROM profiles",
    "structured_terms": f"""WITH {QUESTIONS}, t AS (SELECT qid, {QUERY_TEXT} AS x FROM asks)
        SELECT qid, {", ".join(f"coalesce(array_to_string({e}, '|'), '') AS {n}" for n, e in (("structured", _structured("x")), ("metrics", _metrics("x")), ("numbers", _numbers("x")), ("years", _once(_matches("x", config.YEAR))), ("strong", _once(_matches("x", config.STRONG))), ("important", _important("x")), ("hints", _hints("x"))))} FROM t""",
    "sub_queries": f"""WITH {QUESTIONS}, t AS (SELECT qid, domain, question, doc_ids, {QUERY_TEXT} AS x, coalesce(array_to_string(doc_ids, ' '), '') AS ids,
            list_sort(list_transform(coalesce(map_entries(options), []), lambda e: {{'key': upper(e.key), 'text': coalesce(e.value, '')}})) AS opts FROM asks),
        signed AS (SELECT *, list_transform(opts, lambda o: {{'key': o.key, 'signs': flatten([{_metrics("o.text")}, {_numbers("o.text")}, {_once(_matches("o.text", config.STRONG))}])}}) AS signs FROM t),
        exact AS (SELECT *, {_once(f"""list_filter(flatten([
                list_transform({_structured("x")}, lambda q: q || ' ' || coalesce(domain, '')),
                list_transform({_metrics("x")}, lambda q: concat_ws(' ', q, array_to_string({_once(_matches("x", config.YEAR))}, ' '), ids)),
                list_transform(list_filter(signs, lambda o: len(o.signs) > 0), lambda o: concat_ws(' ', question, o.key, array_to_string(o.signs, ' '), nullif(ids, ''))),
                coalesce(doc_ids, []), {_hints("x")}]), lambda q: trim(q) <> '')""")}[1:30] AS short FROM signed),
        every AS (SELECT qid, domain, flatten([[{{'kind': 'global', 'option': NULL::VARCHAR, 'query': x, 'k': 36}}],
                list_transform(opts, lambda o: {{'kind': 'option', 'option': o.key, 'query': coalesce(question, '') || chr(10) || '选项' || o.key || ': ' || o.text, 'k': 8}}),
                list_transform(short, lambda q: {{'kind': 'exact', 'option': NULL::VARCHAR, 'query': q, 'k': 8}})]) AS a FROM exact),
        flat AS (SELECT qid, domain, generate_subscripts(a, 1) - 1 AS seq, unnest(a) AS s FROM every)
        SELECT qid, seq, s.kind AS kind, s.option AS option, s.query AS query, s.k AS k, domain FROM flat WHERE trim(s.query) <> ''""",
    "search_chunks": f"""WITH {CHUNKS}, {QUESTIONS}, {WANTED}, {_ranked_chunks(10)}
        SELECT query_id, rank, chunk_id, doc_id, score, coalesce(array_to_string(matched, '|'), '') AS matched FROM ranked""",
    "search_docs": f"""WITH {CHUNKS}, {QUESTIONS}, {WANTED_DOCS}, {_ranked_chunks(100)}, {PROFILES},
        words AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(tokens) AS term FROM asked) WHERE length(term) >= 2),
        docs AS (SELECT DISTINCT doc_id FROM corpus),
        parts AS (SELECT query_id, doc_id, score AS s FROM ranked
            UNION ALL SELECT query_id, doc_id, s FROM (
                SELECT query_id, doc_id, least(1.5, 0.2 * cnt) AS s FROM words JOIN profiles USING (term)
                UNION ALL SELECT query_id, doc_id, 2.0 FROM (SELECT query_id, unnest(structured) AS term FROM asked) JOIN profiles USING (term)
                UNION ALL SELECT query_id, doc_id, CASE WHEN contains(low, lower(doc_id)) THEN 12.0 ELSE 0 END + CASE WHEN len(list_filter({ALIASES}, lambda a: contains(low, a))) > 0 THEN 8.0 ELSE 0 END FROM asked CROSS JOIN docs) x
                JOIN wanted USING (query_id)
                WHERE s > 0 AND (wanted.domain = '' OR EXISTS (SELECT 1 FROM corpus WHERE corpus.doc_id = x.doc_id AND corpus.domain = wanted.domain)))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 6) DESC, doc_id) AS rank, doc_id, round(sum(s), 6) AS score FROM parts GROUP BY query_id, doc_id QUALIFY rank <= 10""",
    "clean_text": f"""SELECT DISTINCT doc_id, md5({_strip(r"regexp_replace(regexp_replace(replace(text, '　', ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS text_md5,
        substr(md5(doc_id || '::0::0'), 1, 12) AS stable_id FROM filings WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
    "doc_meta": r"""SELECT DISTINCT doc_id, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS folder,
        trim(regexp_replace(regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1), '[_\-]+', ' ', 'g')) AS file_title, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS suffix
        FROM filings WHERE doc_id IS NOT NULL AND path IS NOT NULL""",
    "page_text": """SELECT DISTINCT doc_id, len(p)::BIGINT AS pages_with_text, md5(coalesce(array_to_string(list_transform(p, lambda x: '[PAGE ' || x.page || ']' || chr(10) || x.text), chr(10) || chr(10)), '')) AS marked_md5
        FROM (SELECT doc_id, list_filter(pages, lambda x: trim(x.text) <> '') AS p FROM filings WHERE doc_id IS NOT NULL AND pages IS NOT NULL)""",
    "paragraph_blocks": rf"""WITH {DOCS},
        raws AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS idx FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS parts FROM docs)),
        marked AS (SELECT *, {_strip("raw")} AS body FROM raws),
        paged AS (SELECT *, regexp_extract(body, '^\[PAGE\s+(\d+)\]', 1) AS mark, {_strip(r"regexp_replace(body, '^\[PAGE\s+\d+\]', '')")} AS text FROM marked),
        placed AS (SELECT *, coalesce(last_value(CASE WHEN mark <> '' THEN mark::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page,
            coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM paged)
        SELECT doc_id, idx::BIGINT AS idx, page::BIGINT AS page, char_start, (char_start + length(raw))::BIGINT AS char_end,
            CASE WHEN regexp_matches(text, '{config.TABLE_LINE}') THEN 'table' ELSE 'text' END AS kind, md5(text) AS text_md5 FROM placed WHERE text <> ''""",
    "keywords": f"""WITH {CHUNKS}, found AS (SELECT chunk_id, list_filter(list_transform(regexp_extract_all(text, '{config.KEYWORD}'), lambda t: {_strip("t")}), lambda t: t <> '') AS k FROM corpus WHERE text IS NOT NULL)
        SELECT chunk_id, coalesce(array_to_string({_distinct("k")}[1:60], '|'), '') AS keywords FROM found""",
    "term_stats": f"""WITH {CHUNKS}, {BAGS}, posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM bags) GROUP BY ALL)
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term""",
    "corpus_stats": f"""WITH {CHUNKS}, {BAGS} SELECT coalesce(domain, '') AS domain, count(*) AS chunks, sum(len(tokens))::BIGINT AS tokens, round(avg(len(tokens)), 6) AS avg_tokens FROM bags GROUP BY 1""",
    "bm25_topk": f"""WITH {CHUNKS}, {QUESTIONS}, {BAGS},
        wanted AS (SELECT qid AS query_id, {QUERY_TEXT} AS query FROM asks),
        terms AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_plain_tokens("query")}) AS term FROM wanted) GROUP BY ALL),
        posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM bags) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM posts GROUP BY term), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM bags),
        scored AS (SELECT query_id, posts.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * least(qf, 3) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len(tokens), 1) / avgdl))), 6) AS score
            FROM terms JOIN posts USING (term) JOIN df USING (term) JOIN bags ON bags.chunk_id = posts.chunk_id CROSS JOIN stats GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, scored.chunk_id) AS rank, scored.chunk_id, score
        FROM scored JOIN corpus ON corpus.chunk_id = scored.chunk_id QUALIFY rank <= 10""",
    "option_values": rf"""WITH {QUESTIONS}, opts AS (SELECT qid, unnest(map_entries(options)) AS e FROM asks),
        found AS (SELECT qid, upper(e.key) AS option, regexp_extract_all(e.value, '({config.VALUE})\s*({config.OPTION_UNIT})?', 1) AS nums, regexp_extract_all(e.value, '({config.VALUE})\s*({config.OPTION_UNIT})?', 2) AS units FROM opts),
        flat AS (SELECT qid, option, generate_subscripts(nums, 1) - 1 AS pos, unnest(nums) AS num, unnest(units) AS unit FROM found)
        SELECT qid, option, pos::BIGINT AS pos, replace(num, ',', '')::DOUBLE AS value, coalesce(unit, '') AS unit FROM flat WHERE coalesce(unit, '') <> '' OR length(num) > 1""",
    "question_kind": f"""WITH {QUESTIONS}, {KINDS}
        SELECT qid, kind, calc AS requires_calculation, comp OR calc AS requires_comparison, n::BIGINT AS option_numeric_count,
            coalesce(array_to_string({_distinct("tags")}, '|'), '') AS tags,
            CASE WHEN regexp_matches(ftext, '同比|增长率|增速|复合增长|CAGR|较.*(增长|下降)') THEN 'yoy' WHEN regexp_matches(ftext, '占比|比重|比例|占.*%') THEN 'ratio'
                 WHEN regexp_matches(ftext, '差额|相差|增加了|减少了|下降了|高出|低于') THEN 'difference' WHEN regexp_matches(ftext, '合计|总计|总额|之和') THEN 'sum' ELSE 'unknown' END AS formula
        FROM (SELECT *, list_filter([CASE WHEN calc THEN 'numeric' END, CASE WHEN comp THEN 'compare' END, CASE WHEN judge THEN 'judgement' END,
            CASE WHEN domain <> '' THEN domain END, CASE WHEN answer_format <> '' THEN answer_format END], lambda t: t IS NOT NULL) AS tags FROM kinds)""",
    "yearly_growth": """WITH y AS (SELECT o_orderpriority, year(o_orderdate)::BIGINT AS year, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1, 2)
        SELECT o_orderpriority, year, amount, round((amount - lag(amount) OVER w) / abs(lag(amount) OVER w) * 100, 4) AS yoy_pct, round(amount / sum(amount) OVER (PARTITION BY o_orderpriority) * 100, 4) AS share_pct
        FROM y WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)""",
    "normalize_answers": f"""WITH {QUESTIONS}, {ANSWERS} SELECT replies.answer_id, {_letters("replies.answer", "replies.option_judgements")} AS letters FROM replies JOIN asks ON replies.qid = asks.qid""",
    "parse_replies": f"""WITH {QUESTIONS}, {ANSWERS}, {PARSED}
        SELECT answer_id, v IS NOT NULL AS is_json, {_letters("said", "judged")} AS letters, coalesce(array_to_string(list_filter(['A', 'B', 'C', 'D'], lambda l: coalesce(judged[l], false)), ''), '') AS judged_true FROM ms""",
    "eval_breakdown": f"""WITH {SCORED}, keyed AS (SELECT pred = gold AS ok, coalesce(domain, '') AS d, coalesce(answer_format, '') AS f, coalesce(type, '') AS t FROM scored)
        SELECT CASE WHEN grouping(d) = 0 THEN 'domain:' || d WHEN grouping(f) = 0 THEN 'format:' || f WHEN grouping(t) = 0 THEN 'type:' || t ELSE 'overall' END AS key,
            count(*) AS total, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy
        FROM keyed GROUP BY GROUPING SETS ((), (d), (f), (t))""",
    "eval_errors": f"WITH {SCORED} SELECT qid, gold, pred, was_missing FROM scored WHERE pred <> gold",
    "run_diagnostics": f"""WITH {DIAGNOSED}, keyed AS (SELECT *, pred = gold AS ok, coalesce(domain, '') AS d, coalesce(answer_format, '') AS f, kind AS k, CASE WHEN calc THEN 'True' ELSE 'False' END AS c FROM diagnosed)
        SELECT CASE WHEN grouping(d) = 0 THEN 'domain:' || d WHEN grouping(f) = 0 THEN 'format:' || f WHEN grouping(k) = 0 THEN 'kind:' || k WHEN grouping(c) = 0 THEN 'calc:' || c ELSE 'overall' END AS key,
            count(*) AS total, count(*) FILTER (failed) AS errors, count(*) FILTER (evidence = 0) AS no_evidence, count(gold) AS with_gold, count(*) FILTER (ok) AS correct,
            CASE WHEN count(gold) > 0 THEN round(count(*) FILTER (ok) / count(gold), 4) END AS accuracy, round(count(*) FILTER (failed) / count(*), 4) AS error_rate,
            round(count(*) FILTER (evidence = 0) / count(*), 4) AS no_evidence_rate
        FROM keyed GROUP BY GROUPING SETS ((), (d), (f), (k), (c))""",
    "suspects": f"""WITH {DIAGNOSED} SELECT qid, failed AS has_error, evidence, gold, pred, (pred = gold)::BIGINT AS correct FROM diagnosed WHERE failed OR evidence = 0 OR pred <> gold""",
    "question_ledger": f"""WITH {ANSWERS} SELECT qid, count(*) AS answers, sum(coalesce(token_usage.prompt_tokens, 0))::BIGINT AS prompt_tokens,
            sum(coalesce(token_usage.completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(token_usage.total_tokens, 0))::BIGINT AS total_tokens
        FROM replies WHERE qid IS NOT NULL GROUP BY ROLLUP (qid)""",
    "token_ledger": f"""WITH {ANSWERS} SELECT run_id, count(*) AS answers, sum(coalesce(token_usage.prompt_tokens, 0))::BIGINT AS prompt_tokens,
            sum(coalesce(token_usage.completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(token_usage.total_tokens, 0))::BIGINT AS total_tokens
        FROM replies WHERE run_id IS NOT NULL GROUP BY ROLLUP (run_id)""",
    "budget_score": f"""WITH {RUNS}, per AS (SELECT run_id, count(*) AS answered, avg((pred = gold)::INT) AS acc, sum(tokens)::BIGINT AS tokens FROM runs WHERE gold IS NOT NULL GROUP BY run_id),
        s AS (SELECT run_id, answered, round(acc, 6) AS accuracy, tokens, round(100 * acc * (0.7 + 0.3 * CASE WHEN tokens <= 0 THEN 0 ELSE greatest(0.0, least(1.0, (5000000 - tokens) / 5000000)) END), 6) AS score FROM per)
        SELECT *, row_number() OVER (ORDER BY score DESC, accuracy DESC, tokens, run_id) AS rank FROM s""",
}
