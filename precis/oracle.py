"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: RE2 has no look-around and no
back-references in patterns, so splits use sentinel characters and the
tokenizer filter uses list lambdas. Fragments are composed into CTEs.
"""

from __future__ import annotations

from .config import ABBREVIATIONS, STOP_WORDS

WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
CAP = 400  # max(10*3, 200) * 2.0; early_termination only
N = 3


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def rr(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {repl}, 'g')"


def squeeze(expr: str) -> str:
    return f"trim({rr(expr, WS + '+', q(' '))})"


def strip_ws(expr: str) -> str:
    return rr(expr, f"^{WS}+|{WS}+$", "''")


# --- splitters -------------------------------------------------------------------------
def clean_split(expr: str) -> str:
    abbrev = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    t = squeeze(expr)
    # guards twice: a boundary consumed by one guard is a protected space for the next
    for _ in range(2):
        t = rr(t, rf"(^|[ (\x{{02}}])((?:{abbrev}|\pL)\.) ", r"'\1\2' || chr(2)")
    for _ in range(2):
        t = rr(t, r"(^|[ (\x{02}])(\p{Nd}[\p{Nd}.,-]*\.) (\p{Ll})", r"'\1\2' || chr(2) || '\3'")
    t = rr(t, r"""([.!?]+["')\]}]*) """, r"'\1' || chr(1)")
    t = rr(t, r"([.!?]+)([;:@*({\[])", r"'\1' || chr(1) || '\2'")
    pieces = f"list_transform(string_split({t}, chr(1)), lambda p: replace(p, chr(2), ' '))"
    long_split = f"string_split({rr('p', r'([.!?]) +', chr(39) + r'\1' + chr(39) + ' || chr(1)')}, chr(1))"
    flat = f"flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > 200 THEN {long_split} ELSE [p] END))"
    return (
        f"list_filter(list_transform({flat}, lambda s: trim(s)), "
        r"lambda s: length(s) >= 10 AND regexp_matches(s, '\pL'))"
    )


def raw_pieces(expr: str) -> str:
    t = f"({expr} || chr(3))"  # end-of-text mark: the last piece is the one ending with it
    return f"string_split({rr(t, f'([.!?]){WS}+', chr(39) + r'\1' + chr(39) + ' || chr(1)')}, chr(1))"


def raw_split(pieces: str) -> str:
    """``pieces`` is a column holding :func:`raw_pieces`."""
    last = f"lambda p: CASE WHEN ends_with(p, chr(3)) THEN {strip_ws('replace(p, chr(3), ' + chr(39) + chr(39) + ')')} ELSE p END"
    return f"list_filter(list_transform({pieces}, {last}), lambda s: regexp_matches(s, {q(NOT_WS)}))"


def normalize_tokens(expr: str) -> str:
    t = f"lower({expr})"
    # opening single quote before a one-character word (not m t s d n)
    t = rr(t, r"'([mtsdn])([^\pL\pN_]|$)", r"chr(3) || '\1\2'")
    t = rr(t, r"'([\pL\pN_])([^\pL\pN_]|$)", r"''' \1\2'")
    t = f"replace({t}, chr(3), '''')"
    t = rr(t, rf"""([^.])\.([\])}}>"'»”’]*){WS}*$""", r"'\1 \2'")
    t = rr(t, r"([^.])\.([!?]*[;:@*({\[])", r"'\1 \2'")
    t = rr(t, r"[:,]([^\p{Nd}])", r"' \1'")
    t = rr(t, r"[:,]$", "' '")
    ws_body = WS[1:-1]
    t = rr(t, rf"""(?:[{ws_body};@#$%&?!*()\[\]{{}}<>"«“‘„»”’`]|''|\.\.+|--)+""", "' '")
    t = f"(' ' || {t} || ' ')"
    t = rr(t, r"([^' ])('s|'m|'d|'ll|'re|'ve|n't|') ", r"'\1 \2 '")
    for a, b in (("can", "not"), ("gim", "me"), ("lem", "me"), ("gon", "na"), ("got", "ta")):
        for _ in range(2):
            t = rr(t, rf"([^\pL\pN_])({a})({b})([^\pL\pN_])", r"'\1\2 \3\4'")
    t = rr(t, r"([^\pL\pN_])(wan)(na) ", r"'\1\2 \3 '")
    return t


STOPS = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"


def terms(expr: str) -> str:
    return (
        f"list_filter(string_split({normalize_tokens(expr)}, ' '), "
        rf"lambda x: regexp_full_match(x, '[\pL\pN]+') AND NOT list_contains({STOPS}, x))"
    )


# --- HTML ----------------------------------------------------------------------------------
ENTITIES = [
    ("&lt;", "'<'"),
    ("&gt;", "'>'"),
    ("&quot;", "'\"'"),
    ("&#39;", "''''"),
    ("&apos;", "''''"),
    ("&nbsp;", "chr(160)"),
    ("&copy;", "chr(169)"),
    ("&middot;", "chr(183)"),
    ("&amp;", "'&'"),
]


def html_text(expr: str, sep: str) -> str:
    t = rr(expr, r"(?is)<script(?:[\s/][^>]*)?>.*?</script\s*>", sep)
    t = rr(t, r"(?is)<style(?:[\s/][^>]*)?>.*?</style\s*>", sep)
    t = rr(t, r"(?s)<!--.*?-->", sep)
    t = rr(t, r"(?s)<[!/?a-zA-Z][^>]*>", sep)
    for ent, ch in ENTITIES:
        t = f"replace({t}, {q(ent)}, {ch})"
    return t


# --- learned boundaries -------------------------------------------------------------------
def _word_sql(w: str) -> str:
    """Columns type, end_, first of a word."""
    core = rr(w, r"""^["'(\[{]+|["')\]}]+$""", "''")
    bare = f"lower(CASE WHEN ends_with(core, '.') THEN left(core, -1) ELSE core END)"
    return (
        f"CASE WHEN regexp_matches({bare}, '^[-+]?\\p{{Nd}}[\\p{{Nd}}.,]*$') THEN '##' ELSE {bare} END AS type, "
        "CASE WHEN regexp_matches(core, '[!?][.!?]*$') THEN 'sure' WHEN ends_with(core, '..') THEN 'ellipsis' WHEN ends_with(core, '.') THEN 'period' ELSE 'plain' END AS end_, "
        "CASE WHEN regexp_matches(core, '^\\p{Lu}') THEN 'upper' WHEN regexp_matches(core, '^\\p{Ll}') THEN 'lower' ELSE 'other' END AS first"
    ).replace("core", f"({core})")


def _ll(both: str, first: str, second: str, n: str) -> str:
    def like(k: str, m: str, p: str) -> str:
        part = lambda c, x: f"(CASE WHEN {c} > 0 THEN ({c}) * ln({x}) ELSE 0 END)"
        return f"{part(k, p)} + {part(f'({m}) - ({k})', f'1 - ({p})')}"

    p, p1, p2 = f"{second}::DOUBLE / {n}", f"{both}::DOUBLE / {first}", f"({second} - {both})::DOUBLE / ({n} - {first})"
    rest, others = f"{second} - {both}", f"{n} - {first}"
    return f"2 * ({like(both, first, p1)} + {like(rest, others, p2)} - ({like(both, first, p)}) - ({like(rest, others, p)}))"


GUARDED = "(a.type IS NOT NULL OR regexp_matches(prev_type, '^\\pL$') OR prev_type = '##')"
BOUNDARY_CTES = f"""toks AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, list_filter(string_split({squeeze('text')}, ' '), lambda x: x <> '') AS ws FROM documents)),
known AS (SELECT doc_id, i, {_word_sql('w')} FROM toks),
word AS (
  SELECT *, lag(type) OVER o AS prev_type, lag(end_) OVER o AS prev_end FROM known WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
types AS (
  SELECT type, count(*) FILTER (end_ <> 'period') AS n_plain, count(*) FILTER (end_ = 'period') AS n_period, count(*) FILTER (first = 'lower') AS n_lower,
         count(*) FILTER (first = 'upper' AND prev_end = 'plain') AS n_upper_mid
  FROM word WHERE regexp_matches(type, '\\pL') OR type = '##' GROUP BY type),
total AS (SELECT sum(n_period)::BIGINT AS np, sum(n_plain + n_period)::BIGINT AS n, least(0.99::DOUBLE, sum(n_period)::DOUBLE / sum(n_plain + n_period)) AS p0 FROM types),
scored_types AS (
  SELECT types.*, CASE WHEN n_period > 0 AND type <> '##' THEN
    2 * (n_period * ln(0.99::DOUBLE) + n_plain * ln(1 - 0.99::DOUBLE) - n_period * ln(p0) - n_plain * ln(1 - p0)) * exp(-(length(replace(type, '.', '')))::DOUBLE)
      * (length(type) - length(replace(type, '.', '')) + 1) * exp(-n_plain * ln(length(replace(type, '.', ''))::DOUBLE)) ELSE 0::DOUBLE END AS score FROM types, total),
abbr AS (SELECT type FROM scored_types WHERE score >= 0.3),
across AS (
  SELECT prev_type, word.type, prev_end = 'sure' OR NOT {GUARDED} AS sure, count(*) AS n
  FROM word LEFT JOIN abbr a ON a.type = prev_type
  WHERE prev_end IN ('period', 'sure') AND (regexp_matches(word.type, '\\pL') OR word.type = '##') GROUP BY ALL),
starts AS (SELECT type, sum(n)::BIGINT AS n_start FROM across WHERE sure GROUP BY type),
start_total AS (SELECT sum(n_start)::BIGINT AS s FROM starts),
starters AS (
  SELECT type, n_start, CASE WHEN n_start * n > (n_plain + n_period) * s THEN {_ll('n_start', 's', '(n_plain + n_period)', 'n')} ELSE 0 END AS likelihood
  FROM starts JOIN types USING (type), total, start_total),
openers AS (SELECT type FROM types WHERE n_lower > 0 AND n_upper_mid = 0 UNION SELECT type FROM starters WHERE likelihood >= 30),
together AS (
  SELECT c.prev_type, c.type AS next_type FROM (SELECT prev_type, type, n AS c12 FROM across WHERE NOT sure AND n > 1) c
  JOIN (SELECT type AS prev_type, n_plain + n_period AS c1 FROM types) x USING (prev_type) JOIN (SELECT type, n_plain + n_period AS c2 FROM types) y USING (type), total
  WHERE c12 * n > c1 * c2 AND {_ll('c12', 'c1', 'c2', 'n')} >= 7.88 AND c.type NOT IN (SELECT type FROM starters WHERE likelihood >= 30))"""


def trained_sql() -> str:
    cut_ = rr(squeeze("text"), r"""([.!?]["')\]}]*) """, r"'\1' || chr(1)")
    return with_(
        BOUNDARY_CTES,
        f"""cuts AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT doc_id, string_split({cut_}, chr(1)) AS ps FROM documents)),
ends AS (
  SELECT doc_id, pos, {_word_sql("regexp_extract(piece, '[^ ]+$')")}, lead(piece) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM cuts),
doubt AS (
  SELECT e.doc_id, e.pos, e.type AS prev_type, e.end_, f.type AS next_type, f.first
  FROM ends e JOIN (SELECT doc_id, pos, {_word_sql("regexp_extract(following, '^[^ ]+')")} FROM ends WHERE following IS NOT NULL) f USING (doc_id, pos)
  WHERE e.end_ IN ('period', 'ellipsis')),
on_ AS (
  SELECT doc_id, pos FROM doubt LEFT JOIN abbr a ON a.type = prev_type LEFT JOIN openers o ON o.type = next_type
    LEFT JOIN together t ON t.prev_type = doubt.prev_type AND t.next_type = doubt.next_type
  WHERE (end_ = 'ellipsis' OR {GUARDED.replace('prev_type', 'doubt.prev_type')}) AND (first = 'lower' OR t.prev_type IS NOT NULL
    OR (NOT (doubt.prev_type = '##' AND end_ = 'period') AND NOT (first = 'upper' AND o.type IS NOT NULL)))),
numbered AS (
  SELECT c.doc_id, c.pos, c.piece, max(CASE WHEN p.pos IS NULL THEN c.pos END) OVER (PARTITION BY c.doc_id ORDER BY c.pos) AS start_
  FROM cuts c LEFT JOIN on_ p ON p.doc_id = c.doc_id AND p.pos = c.pos - 1),
wholes AS (SELECT doc_id, start_, string_agg(piece, ' ' ORDER BY pos) AS s FROM numbered GROUP BY doc_id, start_),
resplit AS (
  SELECT doc_id, start_, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sub
  FROM (SELECT doc_id, start_, CASE WHEN length(s) > 200 THEN string_split({rr('s', r'([.!?]) +', "'" + chr(92) + "1' || chr(1)")}, chr(1)) ELSE [s] END AS parts FROM wholes))""",
    ) + """SELECT doc_id, CAST(start_ * 4294967296 + sub AS BIGINT) AS seq, trim(sentence) AS sentence FROM resplit
WHERE length(trim(sentence)) >= 10 AND regexp_matches(trim(sentence), '\\pL')"""


# --- shared CTE chains -------------------------------------------------------------------
def sentences_cte(split_fn=None, src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    arr = (split_fn or clean_split)(text)
    return f"""sents AS (
  SELECT {key} AS doc_id, unnest(generate_series(0, len(arr) - 1)) AS seq, unnest(arr) AS sentence
  FROM (SELECT {key}, {arr} AS arr FROM {src}))"""


def chunked_sentences_cte(size: int) -> str:
    return f"""chunks AS (
  SELECT doc_id, chunk_no, substring(text, chunk_no * {size} + 1, {size}) AS chunk
  FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / {size}) AS BIGINT) - 1)) AS chunk_no
        FROM documents)
  WHERE regexp_matches(substring(text, chunk_no * {size} + 1, {size}), {q(NOT_WS)})),
sents AS (
  SELECT doc_id, chunk_no * 4294967296 + pos AS seq, sentence FROM (
    SELECT doc_id, chunk_no, unnest(generate_series(0, len(arr) - 1)) AS pos, unnest(arr) AS sentence
    FROM (SELECT doc_id, chunk_no, {clean_split('chunk')} AS arr FROM chunks)))"""


VALID_CTES = f"""lenf AS (
  SELECT * FROM sents WHERE length(sentence) BETWEEN 40 AND 1000),
tok AS (
  SELECT doc_id, seq, sentence, {terms('sentence')} AS terms FROM lenf),
valid AS (
  SELECT doc_id, seq, sentence, terms, len(terms) AS n_words FROM tok WHERE len(terms) >= 8)"""

KEPT_CTES = """kept AS (
  SELECT doc_id, seq, sentence, terms, n_words, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM valid)"""

TF_CTES = """term_rows AS (
  SELECT doc_id, idx, n, n_words, unnest(terms) AS term, unnest(generate_series(0, len(terms) - 1)) AS tok_pos
  FROM kept),
tf AS (
  SELECT doc_id, idx, term, count(*) AS tf, min(tok_pos) AS first_pos, max(n) AS n, max(n_words) AS n_words
  FROM term_rows GROUP BY doc_id, idx, term),
dfq AS (
  SELECT doc_id, term, count(*) AS df FROM tf GROUP BY doc_id, term),
tfidf AS (
  SELECT tf.*, dfq.df, ln(CAST(tf.n + 1 AS DOUBLE) / CAST(dfq.df + 1 AS DOUBLE)) + 1 AS idf
  FROM tf JOIN dfq USING (doc_id, term))"""

SCORE_CTES = f"""scores AS (
  SELECT doc_id, idx, max(n_words) AS n_words,
         round(sum(tf * idf) / sqrt(sum((tf * idf) * (tf * idf))), 9) AS score_l2,
         round(sum(CAST(tf AS DOUBLE) / CAST(greatest(n_words, 1) AS DOUBLE) * idf), 9) AS score_raw
  FROM tfidf GROUP BY doc_id, idx),
mm AS (
  SELECT *, min(score_raw) OVER (PARTITION BY doc_id) AS lo, max(score_raw) OVER (PARTITION BY doc_id) AS hi
  FROM scores),
blended AS (
  SELECT doc_id, idx, n_words, score_l2, score_raw,
         {d(0.5)} * (CASE WHEN hi <> lo THEN (score_raw - lo) / (hi - lo) ELSE {d(1.0)} END)
         + {d(0.3)} * ({d(1.0)} / ({d(1.0)} + CAST(idx AS DOUBLE) * {d(0.05)}))
         + {d(0.2)} * (least({d(1.0)}, CAST(n_words AS DOUBLE) / {d(50.0)})
                       * greatest({d(0.1)}, {d(1.0)} - CAST(n_words AS DOUBLE) / {d(100.0)})) AS score
  FROM mm)"""


def greedy_ctes(n: int = N) -> str:
    """Greedy pick unrolled: each round picks the first arg-max and multiplies
    the remaining scores by the penalties of that pick."""
    parts = ["r0 AS (SELECT doc_id, idx, n_words, score AS cur FROM blended)"]
    for k in range(1, n + 1):
        prev = f"r{k - 1}"
        parts.append(
            f"""p{k} AS (
  SELECT doc_id, idx AS pidx, n_words AS plen FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cur DESC, idx ASC) AS o FROM {prev}) WHERE o = 1)"""
        )
        parts.append(
            f"""r{k} AS (
  SELECT r.doc_id, r.idx, r.n_words,
         r.cur * (CASE WHEN abs(r.idx - p.pidx) < 3 THEN {d(0.3)} ELSE {d(1.0)} END)
               * (CASE WHEN abs(r.n_words - p.plen) < 5 THEN {d(0.8)} ELSE {d(1.0)} END) AS cur
  FROM {prev} r JOIN p{k} p USING (doc_id) WHERE r.idx <> p.pidx)"""
        )
    parts.append("picks AS (" + " UNION ALL ".join(f"SELECT doc_id, pidx AS idx FROM p{k}" for k in range(1, n + 1)) + ")")
    return ",\n".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CLEAN = sentences_cte()
PIPE = (CLEAN, VALID_CTES, KEPT_CTES, TF_CTES)


# --- one SQL text per registered query ------------------------------------------------------
SCORED = PIPE + (SCORE_CTES,)
R = 9


def _sel(ctes, body: str) -> str:
    return with_(*ctes) + body


def summary_sql(ctes_head, algorithm: str) -> str:
    base = ctes_head + (VALID_CTES, KEPT_CTES, TF_CTES, SCORE_CTES)
    if algorithm == "default":
        return _sel(
            base,
            """SELECT c.doc_id, CAST(c.idx AS BIGINT) AS idx, c.sentence, round(s.score_l2, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_l2 DESC, idx DESC) AS o FROM scores) s
JOIN kept c USING (doc_id, idx) WHERE s.o <= 3""",
        )
    return _sel(
        base + (greedy_ctes(),),
        """SELECT c.doc_id, CAST(c.idx AS BIGINT) AS idx, c.sentence, round(b.score, 9) AS score
FROM picks p JOIN kept c USING (doc_id, idx) JOIN blended b USING (doc_id, idx)""",
    )


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["squeeze_whitespace"] = f"SELECT doc_id, {squeeze('text')} AS text FROM documents"
    sql["preprocess_text"] = (
        "SELECT doc_id, "
        + rr("lower(text)", r"[^\pL\pN_" + WS[1:-1] + "]", "''")
        + " AS text FROM documents"
    )
    sql["html_to_text"] = f"SELECT page_id, {squeeze(html_text('html', q(' ')))} AS text FROM pages"
    sql["html_to_text_glued"] = f"SELECT page_id, {html_text('html', q(''))} AS text FROM pages"
    sql["assemble_conversation"] = (
        "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations "
        f"WHERE text IS NOT NULL AND regexp_matches(text, {q(NOT_WS)}) GROUP BY conv_id"
    )
    sql["chunk_text"] = _sel(
        (chunked_sentences_cte(1024).split(",\nsents AS")[0],), "SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk FROM chunks"
    )
    sql["sentences_raw"] = (
        "SELECT doc_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS BIGINT) AS seq, unnest(arr) AS sentence "
        f"FROM (SELECT doc_id, {raw_split('pcs')} AS arr FROM (SELECT doc_id, {raw_pieces('text')} AS pcs FROM documents))"
    )
    # mark every white-space character after . ? !, take the mark back after "x.y." and
    # split at the marks (what the negative look-ahead forbids cannot follow: white space does)
    marked = rr(rr("text", f"([.?!])({WS})", r"'\1' || chr(1) || '\2'"), r"([\pL\pN_]\.[\pL\pN_][.?!])\x{01}", r"'\1'")
    abbrev = f"list_filter(string_split({rr(marked, r'(?s)\x{01}.', 'chr(1)')}, chr(1)), lambda s: regexp_matches(s, {q(NOT_WS)}))"
    sql["sentences_abbrev"] = (
        "SELECT doc_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS BIGINT) AS seq, unnest(arr) AS sentence "
        f"FROM (SELECT doc_id, {abbrev} AS arr FROM documents)"
    )
    sql["sentences_clean"] = _sel((CLEAN,), "SELECT doc_id, CAST(seq AS BIGINT) AS seq, sentence FROM sents")
    sql["sentences_valid"] = (
        f"SELECT * FROM ({sql['sentences_raw']}) WHERE length(sentence) >= 10 AND regexp_matches(sentence, '\\pL')"
    )
    sql["sentences_chunked"] = _sel((chunked_sentences_cte(1024),), "SELECT doc_id, CAST(seq AS BIGINT) AS seq, sentence FROM sents")
    sql["length_filter"] = _sel(
        (CLEAN,), "SELECT doc_id, CAST(seq AS BIGINT) AS seq, sentence FROM sents WHERE length(sentence) BETWEEN 40 AND 1000"
    )
    sql["tokens"] = _sel(
        (CLEAN,),
        f"""SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(unnest(generate_series(0, len(t) - 1)) AS BIGINT) AS tok_pos, unnest(t) AS token
FROM (SELECT doc_id, seq, list_filter(string_split(trim({normalize_tokens('sentence')}), ' '), lambda x: length(x) > 0) AS t
      FROM sents WHERE length(sentence) BETWEEN 40 AND 1000)""",
    )
    sql["tokens_filtered"] = _sel(
        (CLEAN, VALID_CTES),
        """SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(unnest(generate_series(0, len(terms) - 1)) AS BIGINT) AS tok_pos,
       unnest(terms) AS term FROM tok""",
    )
    by_lang = terms("sentence").replace("AND NOT list_contains", "AND NOT (lang IS NOT DISTINCT FROM 'en' AND list_contains").rstrip(")") + ")))"
    sql["tokens_filtered_lang"] = _sel(
        (CLEAN,),
        f"""SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(unnest(generate_series(0, len(t) - 1)) AS BIGINT) AS tok_pos, unnest(t) AS term
FROM (SELECT s.doc_id, seq, {by_lang} AS t FROM sents s JOIN documents d USING (doc_id) WHERE length(sentence) BETWEEN 40 AND 1000)""",
    )
    sql["valid_sentences"] = _sel(
        (CLEAN, VALID_CTES), "SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(n_words AS BIGINT) AS n_words, sentence FROM valid"
    )
    sql["early_termination"] = _sel(
        (CLEAN, VALID_CTES),
        f"""SELECT source, CAST(rn - 1 AS BIGINT) AS idx, doc_id, CAST(seq AS BIGINT) AS seq,
       CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS n, sentence
FROM (SELECT d.source, v.doc_id, v.seq, v.sentence, row_number() OVER (PARTITION BY d.source ORDER BY v.doc_id, v.seq) AS rn
      FROM valid v JOIN documents d USING (doc_id)) WHERE rn <= {CAP}""",
    )
    sql["early_stop"] = _sel(
        (CLEAN, VALID_CTES),
        """SELECT doc_id, idx, seq, least(n, 20) AS n, n_words, sentence FROM (
  SELECT doc_id, row_number() OVER o - 1 AS idx, CAST(seq AS BIGINT) AS seq, count(*) OVER (PARTITION BY doc_id) AS n,
         CAST(n_words AS BIGINT) AS n_words, sentence FROM valid WINDOW o AS (PARTITION BY doc_id ORDER BY seq)) WHERE idx < 20""",
    )
    sql["boundary_types"] = with_(BOUNDARY_CTES) + (
        "SELECT type, n_plain, n_period, n_lower, n_upper_mid, round(score, 6) + 0::DOUBLE AS score, CAST(score >= 0.3 AS BIGINT) AS abbreviation FROM scored_types WHERE n_period > 0"
    )
    sql["boundary_starters"] = with_(BOUNDARY_CTES) + (
        "SELECT type, n_start, round(likelihood, 5) AS likelihood, CAST(likelihood >= 30 AS BIGINT) AS starter FROM starters"
    )
    sql["sentences_trained"] = trained_sql()
    sql["term_frequency"] = _sel(PIPE, "SELECT doc_id, CAST(idx AS BIGINT) AS idx, term, CAST(tf AS BIGINT) AS tf FROM tf")
    sql["document_frequency"] = _sel(PIPE, "SELECT doc_id, term, CAST(df AS BIGINT) AS df FROM dfq")
    sql["idf"] = _sel(PIPE, f"SELECT DISTINCT doc_id, term, CAST(df AS BIGINT) AS df, round(idf, {R}) AS idf FROM tfidf")
    sql["tfidf_relative"] = _sel(
        PIPE,
        f"SELECT doc_id, CAST(idx AS BIGINT) AS idx, term, round(CAST(tf AS DOUBLE) / CAST(greatest(n_words, 1) AS DOUBLE) * idf, {R}) AS weight FROM tfidf",
    )
    sql["tfidf_l2"] = _sel(
        PIPE,
        f"""SELECT doc_id, CAST(idx AS BIGINT) AS idx, term,
       round((tf * idf) / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id, idx)), {R}) AS weight FROM tfidf""",
    )
    vocab_body = """SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fi, fp) - 1 AS BIGINT) AS term_idx
FROM (SELECT doc_id, term, arg_min(idx, idx * 1000000 + first_pos) AS fi, arg_min(first_pos, idx * 1000000 + first_pos) AS fp
      FROM tf GROUP BY doc_id, term)"""
    sql["vocabulary"] = _sel(PIPE, vocab_body)
    sql["vocabulary_merge"] = sql["vocabulary"]
    sql["sentence_vectors"] = _sel(
        PIPE + (f"vocab AS ({vocab_body})",),
        "SELECT tf.doc_id, CAST(tf.idx AS BIGINT) AS idx, vocab.term_idx, CAST(tf.tf AS BIGINT) AS tf FROM tf JOIN vocab USING (doc_id, term)",
    )
    bench_vocab = f"""bsents AS (
  SELECT item_id AS doc_id, unnest(arr) AS sentence FROM (SELECT item_id, {clean_split('text')} AS arr FROM benchmark)),
bvocab AS (
  SELECT DISTINCT unnest({terms('sentence')}) AS term FROM bsents)"""
    sql["vocabulary_semi"] = _sel(
        PIPE + (bench_vocab,),
        "SELECT doc_id, CAST(idx AS BIGINT) AS idx, term, CAST(tf AS BIGINT) AS tf FROM tf WHERE term IN (SELECT term FROM bvocab)",
    )
    sql["idf_corpus"] = _sel(
        PIPE,
        f"""SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df,
       round(ln(CAST((SELECT count(DISTINCT doc_id) FROM kept) + 1 AS DOUBLE) / CAST(count(DISTINCT doc_id) + 1 AS DOUBLE)) + 1, {R}) AS idf
FROM tf GROUP BY term""",
    )
    sql["score_l2"] = _sel(SCORED, "SELECT doc_id, CAST(idx AS BIGINT) AS idx, score_l2 AS score FROM scores")
    sql["score_raw"] = _sel(SCORED, "SELECT doc_id, CAST(idx AS BIGINT) AS idx, score_raw AS score FROM scores")
    sql["score_blended"] = _sel(SCORED, f"SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(score, {R}) AS score FROM blended")
    sql["score_stats"] = _sel(
        SCORED,
        f"""SELECT doc_id, round(avg(score), {R}) AS mean_score, round(stddev_pop(score), {R}) AS std_score,
       round(max(score), {R}) AS max_score, round(min(score), {R}) AS min_score FROM blended GROUP BY doc_id""",
    )
    sql["top_n_sentences"] = _sel(
        SCORED,
        """SELECT doc_id, CAST(o AS BIGINT) AS pick_rank, CAST(idx AS BIGINT) AS idx, score_l2 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_l2 DESC, idx DESC) AS o FROM scores) WHERE o <= 3""",
    )
    sql["diverse_selection"] = _sel(
        SCORED + (greedy_ctes(),),
        f"SELECT p.doc_id, CAST(p.idx AS BIGINT) AS idx, round(b.score, {R}) AS score FROM picks p JOIN blended b USING (doc_id, idx)",
    )
    sql["near_sentence_pairs"] = _sel(
        (CLEAN, VALID_CTES, KEPT_CTES),
        """SELECT a.doc_id, CAST(a.idx AS BIGINT) AS idx_a, CAST(b.idx AS BIGINT) AS idx_b,
       CAST(b.n_words - a.n_words AS BIGINT) AS len_diff
FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.idx - a.idx BETWEEN 1 AND 2
WHERE abs(a.n_words - b.n_words) < 5""",
    )
    sql["summarize_default"] = summary_sql((CLEAN,), "default")
    sql["summarize_diverse"] = summary_sql((CLEAN,), "diverse")
    raw_cte = (
        "sents AS (SELECT doc_id, unnest(generate_series(0, len(arr) - 1)) AS seq, unnest(arr) AS sentence "
        f"FROM (SELECT doc_id, {raw_split('pcs')} AS arr FROM (SELECT doc_id, {raw_pieces('text')} AS pcs FROM documents)))"
    )
    sql["summarize_trained"] = summary_sql((f"sents AS ({trained_sql()})",), "default")
    sql["summarize_raw"] = summary_sql((raw_cte,), "default")
    sql["summarize_raw_diverse"] = summary_sql((raw_cte,), "diverse")
    sql["summarize_chunked"] = summary_sql((chunked_sentences_cte(1024),), "diverse")
    sql["summarize_chunked_default"] = summary_sql((chunked_sentences_cte(1024),), "default")
    sql["file_extension"] = """SELECT page_id, lower(list_last(string_split(list_last(string_split(url, '/')), '.'))) AS ext FROM pages"""
    sql["decode_bytes"] = "SELECT doc_id, text FROM documents"
    ascii_ = rr("text", "[^\\x00-\\x7F]", "''")
    latin, cyrillic = "etaoinshrdlucmwfgypbvkjxqzETAOINSHRDLUCMWFGYPBVKJXQZ", "оеаинтсрвлкмдпуяыьгзбчйхжшОЕАИНТСРВЛКМДПУЯЫЬГЗБЧЙХЖШ"
    kana = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
    sql["decode_legacy"] = (
        f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN translate({ascii_}, '{latin}', '{cyrillic}') "
        f"ELSE translate(lower({ascii_}), '{latin[:26]}', '{kana}') END AS text FROM documents"
    )
    pages_cte = f"pdocs AS (SELECT page_id AS doc_id, {squeeze(html_text('html', q(' ')))} AS text FROM pages)"
    sql["summarize_pages"] = summary_sql((pages_cte, sentences_cte(src="pdocs")), "default")
    conv_cte = (
        "cdocs AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations "
        f"WHERE text IS NOT NULL AND regexp_matches(text, {q(NOT_WS)}) GROUP BY conv_id)"
    )
    sql["summarize_conversations"] = summary_sql((conv_cte, sentences_cte(src="cdocs")), "diverse")
    sql["summary_status"] = _sel(
        (CLEAN, VALID_CTES),
        """SELECT d.doc_id, CASE WHEN v.c IS NULL THEN 'no_valid_sentences' ELSE 'ok' END AS status,
       CAST(coalesce(v.c, 0) AS BIGINT) AS n_valid
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c FROM valid GROUP BY doc_id) v USING (doc_id)""",
    )
    sql["rejected_documents"] = _sel(
        (CLEAN, VALID_CTES), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM valid)"
    )
    return sql
