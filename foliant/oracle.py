"""DuckDB SQL with the same results as the registered queries.

Written from the definition of each operator, with row-wise lists and global
windows where the Spark side has blocks and partial sums. Queries without an
entry need back-references or iteration, and are tested against Python.
"""

from __future__ import annotations

from foliant import config as C

SQL: dict[str, str] = {}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- fragments -------------------------------------------------------------


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^ \t\n\x0B\f\r]+')"


def ids_of(w: str) -> str:
    return f"list_transform({w}, lambda w: (('0x' || substr(md5(w), 1, 6))::INTEGER % 32000 + 3))"


def ids(x: str) -> str:
    return ids_of(words(x))


def bos_ids(x: str) -> str:
    return f"list_concat([1], {ids(x)})"


def join(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN len({x}) = 0 THEN '' ELSE array_to_string({x}, ',') END"


def fill(value: int, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {value})"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def total(x: str) -> str:
    return f"coalesce(list_sum({x}), 0)::BIGINT"


STRIP = _lit(C.BLANKS)

PAIRS = """pairs AS (
  SELECT u.conv_id * 1048576 + u.turn AS row_id, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

LOGITS = """logits AS (
  SELECT vec_id // 10 AS sample_id, vec_id % 10 AS pos, vec_id, embedding::DOUBLE[] AS e,
         CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS label, label AS gold,
         CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask
  FROM embeddings),
lse AS (
  SELECT *, list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) AS z
  FROM logits),
scored AS (
  SELECT *, CASE WHEN label = -100 THEN 0.0 ELSE z - e[label + 1] END AS nll FROM lse)"""

SAMPLE_COLUMNS = f"""{join('i')} AS input_ids, {join('l')} AS labels,
  {join(fill(1, 'len(i)'))} AS attention_mask, len(i)::BIGINT AS length, row_id AS index"""


def lm_sample_rows(low: int, high: int, text: str = "text") -> str:
    return f"""SELECT doc_id AS row_id, i, i AS l FROM (
      SELECT doc_id, ({bos_ids(text)})[1:{high}] AS i FROM documents)
    WHERE len(i) >= {low}"""


def sft_prompt_rows(limit: int, least: int = 1) -> str:
    return f"""SELECT row_id, o, CASE WHEN len(w) + 1 > room AND half > 0 THEN
        CASE WHEN len(h) = 0 THEN t
        ELSE list_concat(list_concat(h[1:len(h) - 1], [h[len(h)] || t[1]]), t[2:]) END
      ELSE w END AS p
    FROM (SELECT *, w[1:greatest(half - 1, 0)] AS h, w[greatest(len(w) - half, 0) + 1:len(w)] AS t
      FROM (SELECT *, {limit} - len(o) AS room, greatest(({limit} - len(o)) // 2, 0) AS half
        FROM (SELECT row_id, {words(f'trim(output, {STRIP})')} AS o,
            {words(f'trim(input, {STRIP})')} AS w
          FROM pairs) WHERE len(o) BETWEEN {least} AND {limit}))"""


def sft_sample_rows(low: int, limit: int) -> str:
    return f"""SELECT row_id, list_concat(x, [2]) AS i,
      list_concat(list_concat({fill(-100, 'len(x) - len(o)')}, x[len(x) - len(o) + 1:]), [2]) AS l
    FROM (SELECT row_id, o, list_concat([1], {ids_of('list_concat(p, o)')}) AS x
      FROM ({sft_prompt_rows(limit)})) WHERE len(x) >= {low}"""


def plan(source: str, **given: str) -> str:
    """A select over chunk-plan columns; those not given take their defaults."""
    columns = {
        "sample_id": "sample_id",
        "seq": "seq",
        "segment": "'context'",
        "input_ids": "NULL",
        "labels": "NULL",
        "loss_mask": "NULL",
        "has_loss": "0",
        "loss_kind": "NULL",
        "prefix_repeat": "0",
        "forward_teacher": "0",
        "do_not_compress": "0",
        "clear_cache": "NULL",
        "loss_denominator": "NULL",
        "prompt_emptied": "0",
    }
    columns.update(given)
    parts = []
    for name, value in columns.items():
        if name in ("input_ids", "labels", "loss_mask"):
            value = "NULL::VARCHAR" if value == "NULL" else join(value)
        elif name in ("segment", "loss_kind"):
            value = f"({value})::VARCHAR"
        elif name in ("clear_cache", "loss_denominator"):
            value = f"({value})::DOUBLE"
        else:
            value = f"({value})::BIGINT"
        parts.append(f"{value} AS {name}")
    return f"SELECT {', '.join(parts)} FROM {source}"


def chunked(source: str, n: int, keep: str = "") -> str:
    """Rows (sample_id, seq, st, c) of a source with a list column ``i``."""
    keep = f", {keep}" if keep else ""
    return f"""(SELECT sample_id, st // {n} AS seq, st, i[st + 1:st + {n}] AS c{keep}
      FROM (SELECT *, unnest(range(0, len(i), {n})) AS st FROM {source}))"""


# --- text ------------------------------------------------------------------

SQL["char_cap"] = """SELECT doc_id AS row_id, substr(text, 1, 1000) AS capped,
  length(substr(text, 1, 131072))::BIGINT AS n_128k FROM documents"""

SQL["min_chars"] = "SELECT doc_id AS row_id, n_chars FROM documents WHERE length(text) > 100"

SQL["lang_filter"] = "SELECT doc_id AS row_id, text FROM documents WHERE lang = 'en'"

SQL["meta_contains"] = """SELECT event_id,
  (json_extract(props, '$.k') IS NOT NULL)::BIGINT AS has_k
  FROM events WHERE contains(props, '"k": 6')"""

SQL["squeeze_symbols"] = """WITH c AS (
  SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY i) AS place FROM g)
SELECT doc_id AS row_id, string_agg(ch, '' ORDER BY i) AS text FROM r
WHERE regexp_matches(ch, '[a-zA-Z0-9]') OR place <= 4 GROUP BY doc_id"""


def collapsed(source: str) -> str:
    """Rows (row_id, text) with repeated units collapsed.

    A match never leaves a maximal alphanumeric run, so distinct runs are
    worked off from left to right: at a place the shortest unit that repeats
    is kept once and its repeats are passed over; without one a character is.
    """
    return f"""(WITH RECURSIVE src AS {source},
parts AS (SELECT row_id, unnest(l) AS part, generate_subscripts(l, 1) AS i
  FROM (SELECT row_id, regexp_extract_all(text, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+') AS l FROM src)),
runs AS (SELECT DISTINCT part AS run FROM parts WHERE length(part) >= 6 AND regexp_matches(part, '^[a-zA-Z0-9]')),
walk AS (SELECT run, 1 AS place, '' AS made FROM runs UNION ALL
  SELECT run, place + CASE WHEN u IS NULL THEN 1 ELSE u * list_max(list_filter(
      range(1, (length(run) - place + 1) // u + 1), lambda k: substr(run, place, u * k) = repeat(substr(run, place, u), k))) END,
    made || substr(run, place, coalesce(u, 1))
  FROM (SELECT *, list_filter(range(3, (length(run) - place + 1) // 2 + 1),
      lambda u: substr(run, place, u) = substr(run, place + u, u))[1] AS u FROM walk WHERE place <= length(run))),
short AS (SELECT run, made FROM walk WHERE place > length(run) AND made <> run),
joined AS (SELECT row_id, string_agg(coalesce(made, part), '' ORDER BY i) AS text
  FROM parts LEFT JOIN short ON part = run GROUP BY row_id)
SELECT src.row_id, coalesce(joined.text, '') AS text FROM src LEFT JOIN joined USING (row_id))"""


SQL["collapse_repeats"] = f"SELECT * FROM {collapsed('(SELECT doc_id AS row_id, text FROM documents)')}"

SQL["clean_then_cap"] = (
    f"SELECT row_id, substr(text, 1, 131072) AS text FROM {collapsed('(' + SQL['squeeze_symbols'] + ')')}"
)

SQL["strip_text"] = f"SELECT doc_id AS row_id, trim(text, {STRIP}) AS text FROM documents"

_PLAIN = f"translate(lower(text), {_lit(C.PUNCTUATION)}, '')"


def _single_blanks(x: str) -> str:
    return f"trim(regexp_replace({x}, '{C.BLANK_CLASS}+', ' ', 'g'), ' ')"


_NO_DIGITS = f"translate({_PLAIN}, '{C.DIGITS}', '')"
SQL["normalize_text"] = f"""SELECT doc_id AS row_id, {_single_blanks(_PLAIN)} AS plain,
  length({_single_blanks(_NO_DIGITS)})::BIGINT AS n_no_digits FROM documents"""

SQL["prompt_texts"] = f"""WITH {PAIRS} SELECT row_id, 'Question: ' || input AS question,
  chr(10) || chr(10) || 'Answer: ' || output AS answer FROM pairs"""

SQL["article_split"] = r"""WITH d AS (
  SELECT source, doc_id, ' ' || chr(10) || ' = Doc ' || doc_id || ' = ' || chr(10) ||
    array_to_string(list_transform(string_split(text, chr(10)),
      lambda x: ' ' || x || ' ' || chr(10)), '') AS t FROM documents),
w AS (SELECT source, string_agg(t, '' ORDER BY doc_id) AS t FROM d GROUP BY source),
p AS (SELECT source, string_split_regex(t, ' \n = [^=]*[^=] = \n ') AS l FROM w),
a AS (SELECT source, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS article FROM p)
SELECT source, article::BIGINT AS article, text FROM a WHERE article > 0 AND length(text) > 100"""

SQL["corpus_by_name"] = """SELECT md5(substr(text, 1, 131072)) AS digest,
  'language modeling' AS task_type FROM documents"""

_CLEANED = collapsed("(" + SQL["squeeze_symbols"] + ")")
_NAMED = {
    "minipile.train": "SELECT text AS body FROM documents",
    "pg19.train": "SELECT text AS body FROM documents",
    "pg19.test.256k": "SELECT substr(text, 1, 262144) AS body FROM documents",
    "proof-pile.1m": "SELECT substr(text, 1, 1048576) AS body FROM documents",
    "code-parrot.256k": "SELECT substr(text, 1, 262144) AS body FROM documents",
    "redpajama arxiv sample.train.1m": "SELECT substr(text, 1, 1048576) AS body FROM documents WHERE doc_id % 2 = 0",
    "redpajama book sample.train.128k": "SELECT substr(text, 1, 131072) AS body FROM documents LIMIT 10000",
    "redpajama v2.train": "SELECT text AS body FROM documents WHERE lang = 'en'",
    "longdata-corpus.128k": f"SELECT substr(text, 1, 131072) AS body FROM {_CLEANED}",
    "longdata-corpus copy": f"SELECT text AS body FROM {_CLEANED}",
    "longalpaca.train.true.deepspeed": "SELECT input || '|' || output AS body FROM pairs",
}
_TAGS = {"longdata-corpus copy": C.COPY_BACK, "longalpaca.train.true.deepspeed": C.QUESTION_ANSWERING}
SQL["corpora_by_name"] = f"WITH {PAIRS} " + " UNION ALL ".join(
    [
        *[
            f"SELECT '{name}' AS name, '{_TAGS.get(name, C.LANGUAGE_MODELING)}' AS task_type, md5(body) AS digest FROM ({rows})"
            for name, rows in _NAMED.items()
        ],
        f"SELECT 'beacons', '{C.LANGUAGE_MODELING}', md5(text) FROM documents",
        f"SELECT 'beacons', '{C.QUESTION_ANSWERING}', md5(input || '|' || output) FROM pairs",
    ]
)

SQL["json_round_trip"] = """SELECT doc_id, md5(text) AS digest,
  (SELECT count(*) FROM documents)::BIGINT AS n_rows FROM documents"""

SQL["file_list_order"] = """SELECT row_number() OVER (ORDER BY (doc_id + 1) % 3, doc_id) - 1 AS row_id,
  doc_id, md5(text) AS digest FROM documents"""

SQL["metrics_log"] = """SELECT run, 'report' AS command, 'none' AS model, lang, count(*)::BIGINT AS n,
  round(avg(n_chars), 6) AS mean_chars FROM documents, (VALUES ('first'), ('second'), ('third')) AS r(run)
GROUP BY run, lang"""

SQL["bounded_rows"] = """SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 100"""

SQL["row_contract"] = """SELECT u.conv_id, u.turn,
  CASE WHEN a.text IS NULL THEN 'response' ELSE '' END AS missing
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""

# --- tokens ----------------------------------------------------------------

DOC_IDS = f"SELECT doc_id AS row_id, lang, text, {bos_ids('text')} AS i FROM documents"

SQL["token_ids"] = f"""SELECT row_id, {join('i')} AS input_ids, len(i)::BIGINT AS length
  FROM ({DOC_IDS})"""

SQL["decode_words"] = f"""SELECT doc_id AS row_id, array_to_string({words('text')}, ' ') AS text
  FROM documents"""

_VOCAB = f"""vocab AS (SELECT word, count(*)::BIGINT AS n,
    (row_number() OVER (ORDER BY count(*) DESC, word) + 3)::BIGINT AS token_id
  FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word
  ORDER BY n DESC, word LIMIT 2000)"""
SQL["vocab_topk"] = f"WITH {_VOCAB} SELECT word, n, token_id FROM vocab"

SQL["vocab_encode"] = f"""WITH {_VOCAB},
d AS (SELECT doc_id, {words('text')} AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM d),
e AS (SELECT doc_id, string_agg(coalesce(token_id, 3)::VARCHAR, ',' ORDER BY i) AS input_ids
  FROM w LEFT JOIN vocab USING (word) GROUP BY doc_id)
SELECT doc_id AS row_id, coalesce(input_ids, '') AS input_ids FROM documents LEFT JOIN e USING (doc_id)"""

SQL["external_tokenizer"] = f"""SELECT doc_id AS row_id, {join('l')} AS input_ids FROM (
  SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''),
    lambda w: length(w)) AS l FROM documents)"""

SQL["head_truncate"] = f"SELECT row_id, {join('i[1:512]')} AS input_ids FROM ({DOC_IDS})"

SQL["middle_truncate_prompt"] = f"""WITH {PAIRS},
t AS (SELECT row_id, {bos_ids('input')} AS p, {bos_ids('output')} AS r FROM pairs),
v AS (SELECT *, greatest(64 - len(r), 0) AS room FROM t),
c AS (SELECT *, CASE WHEN len(p) + len(r) > 64
  THEN list_concat(p[1:room // 2], p[len(p) - (room - room // 2) + 1:len(p)]) ELSE p END AS k FROM v)
SELECT row_id, {join('k')} AS prompt, len(r)::BIGINT AS response_length FROM c"""

SQL["middle_truncate_chars"] = """SELECT doc_id AS row_id, CASE WHEN length(text) > 1001
  THEN substr(text, 1, 500) || right(text, 501) ELSE text END AS text FROM documents"""

SQL["length_filter"] = f"""SELECT row_id, len(i)::BIGINT AS length, row_id AS index
  FROM ({DOC_IDS}) WHERE len(i) BETWEEN 50 AND 512"""

SQL["label_shift"] = f"""SELECT row_id, {join('list_concat(i[2:], [-100])')} AS labels
  FROM ({DOC_IDS})"""

SQL["mask_fill"] = f"""SELECT row_id,
  {join('list_transform(i, lambda x: CASE WHEN x % 3 = 0 THEN -100 ELSE x END)')} AS labels,
  len(list_filter(i, lambda x: x % 3 <> 0))::BIGINT AS valid FROM ({DOC_IDS})"""

SQL["append_eos"] = f"""SELECT row_id, {join('list_concat(i, [2])')} AS input_ids,
  {join('list_concat(i, [2])')} AS labels, {join(fill(1, 'len(i) + 1'))} AS attention_mask,
  {join('range(0, len(i) + 1)')} AS position_ids FROM ({DOC_IDS})"""

SQL["remove_eos"] = f"""SELECT row_id, {join('list_concat(i, [2])')} AS input_ids,
  {join('list_filter(range(0, len(i) + 2), lambda p: p <> least(5, len(i)))')} AS position_ids
  FROM ({DOC_IDS})"""

SQL["mask_replace"] = f"""SELECT row_id,
  {join('list_transform(i, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)')} AS values,
  least(len(i), 128)::BIGINT AS longest FROM ({DOC_IDS})"""

SQL["sft_separator"] = f"""WITH {PAIRS} SELECT row_id,
  [' ', chr(10), chr(10) || chr(10)][{draw('row_id', '42', "'separator'")} % 3 + 1] AS separator
  FROM pairs"""

SQL["equal_lengths"] = f"""SELECT row_id, 1::BIGINT AS labels_match,
  (len(i) % 2)::BIGINT AS all_match FROM ({DOC_IDS})"""

# --- samples ---------------------------------------------------------------

SQL["lm_samples"] = f"SELECT row_id, {SAMPLE_COLUMNS} FROM ({lm_sample_rows(50, 512)})"

SQL["lm_samples_bounded"] = f"""SELECT row_id, {SAMPLE_COLUMNS}
  FROM ({lm_sample_rows(50, 512, 'substr(text, 1, 2560)')})"""

SQL["sft_samples"] = f"""WITH {PAIRS} SELECT row_id, {SAMPLE_COLUMNS}
  FROM ({sft_sample_rows(16, 256)})"""

SQL["sft_eval_samples"] = f"""WITH {PAIRS} SELECT row_id, {join('i')} AS input_ids,
  {join(fill(1, 'len(i)'))} AS attention_mask, len(i)::BIGINT AS length, row_id AS index
  FROM (SELECT row_id, list_concat([1], {ids_of('p')}) AS i FROM ({sft_prompt_rows(256, 0)}))"""

SQL["pretokenized_filter"] = f"""SELECT row_id, {SAMPLE_COLUMNS} FROM (
  SELECT row_id, i, list_concat(i[2:], [-100]) AS l FROM ({DOC_IDS}) WHERE len(i) BETWEEN 50 AND 512)"""

SQL["mixed_shape_samples"] = f"""WITH {PAIRS}, s AS (
  SELECT 0 AS part, * FROM ({lm_sample_rows(16, 256)})
  UNION ALL SELECT 1, * FROM ({sft_sample_rows(16, 256)})
  UNION ALL SELECT 2, row_id, i, i FROM ({DOC_IDS}) WHERE len(i) BETWEEN 16 AND 256)
SELECT row_id, part::BIGINT AS part, {SAMPLE_COLUMNS} FROM s"""

SQL["mixed_eval_samples"] = f"""WITH {PAIRS}, s AS (
  SELECT 0 AS part, * FROM ({lm_sample_rows(16, 256)})
  UNION ALL SELECT 1, row_id, list_concat([1], {ids_of('p')}), NULL FROM ({sft_prompt_rows(256, 0)})
  UNION ALL SELECT 2, row_id, i, i FROM ({DOC_IDS}) WHERE len(i) BETWEEN 16 AND 256)
SELECT row_id, part::BIGINT AS part, {SAMPLE_COLUMNS} FROM s"""

SQL["row_function"] = f"""SELECT doc_id AS row_id,
  len(regexp_extract_all(text, '{C.BLANK_CLASS.replace('[', '[^')}+'))::BIGINT AS n_words,
  length(text)::BIGINT AS n_chars FROM documents WHERE lang = 'en'"""

SQL["capped_per_source"] = """SELECT doc_id AS row_id, source, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY md5(concat_ws('|', source, doc_id, 42)), doc_id) AS place FROM documents)
  WHERE place <= 30"""

SQL["two_part_corpus"] = f"""WITH {PAIRS}
SELECT doc_id AS row_id, doc_id AS part_row, text, 'language modeling' AS task_type, 0::BIGINT AS part,
  NULL::VARCHAR AS prompt, NULL::VARCHAR AS response, NULL::DOUBLE AS train_prompt FROM documents
UNION ALL
SELECT row_id + (SELECT max(doc_id) + 1 FROM documents), row_id, NULL, 'question answering', 1, input, output, 0
FROM pairs"""

SQL["sampled_corpus"] = f"""WITH {PAIRS}, s AS (
  SELECT 0 AS part, * FROM ({lm_sample_rows(50, 512)})
  UNION ALL SELECT 1, row_id + (SELECT max(doc_id) + 1 FROM documents), i, l FROM ({sft_sample_rows(50, 512)})),
k AS (SELECT *, row_number() OVER (PARTITION BY part
  ORDER BY md5(concat_ws('|', part, row_id, 42)), row_id) AS place FROM s)
SELECT row_id, part::BIGINT AS part, {SAMPLE_COLUMNS}, 0::BIGINT AS distill,
  'activation beacons' AS task_type FROM k WHERE place <= 150"""

# --- planners --------------------------------------------------------------

_DOC_LISTS = f"(SELECT doc_id AS sample_id, {bos_ids('text')} AS i FROM documents)"

SQL["chunk_lm"] = plan(
    chunked(_DOC_LISTS, 128),
    input_ids="c",
    labels="c[2:]",
    loss_mask=fill(1, "len(c) - 1"),
    has_loss="len(c) > 1",
    loss_kind="CASE WHEN len(c) > 1 THEN 'ce' END",
    loss_denominator="CASE WHEN len(c) > 1 THEN len(c) - 1 END",
)

SQL["chunk_ppl"] = plan(
    chunked(f"(SELECT sample_id, i[1:1024] AS i FROM {_DOC_LISTS})", 128),
    input_ids="c",
    labels="c[2:]",
    loss_mask=fill(1, "len(c) - 1"),
    has_loss="1",
    loss_kind="'ppl'",
    loss_denominator="len(c) - 1",
)

SQL["chunk_qa"] = f"""WITH {PAIRS},
t AS (SELECT row_id, {bos_ids('input')} AS p, {bos_ids('output')} AS r FROM pairs),
v AS (SELECT *, greatest(128 - len(r), 0) AS room FROM t),
k AS (SELECT row_id AS sample_id, r, CASE WHEN len(p) + len(r) > 128
  THEN list_concat(p[1:room // 2], p[len(p) - (room - room // 2) + 1:len(p)]) ELSE p END AS p FROM v),
f AS (SELECT sample_id, len(p) AS np, len(r) >= 128 AS e, list_concat(p, r) AS i,
  list_concat({fill(0, 'len(p)')}, {fill(1, 'len(r)')}) AS m FROM k),
g AS (SELECT *, m[st + 1:st + 32][2:] AS k FROM {chunked('f', 32, 'm, np, e')})
""" + plan(
    "g",
    segment="CASE WHEN st < np THEN 'prompt' ELSE 'response' END",
    input_ids="c",
    labels="c[2:]",
    loss_mask="k",
    has_loss=f"seq > 0 AND {total('k')} > 0",
    loss_kind=f"CASE WHEN seq > 0 AND {total('k')} > 0 THEN 'ce' END",
    loss_denominator=f"CASE WHEN seq > 0 AND {total('k')} > 0 THEN {total('k')} END",
    prompt_emptied="e",
)

_PIECES = f"""pieces AS (SELECT doc_id * 1048576 + st // 31 AS sample_id, w[st + 1:st + 31] AS w
  FROM (SELECT doc_id, w, unnest(range(0, len(w), 31)) AS st
    FROM (SELECT doc_id, {words('text')} AS w FROM documents))),
t AS (SELECT sample_id, len(w) AS n, list_concat([1], {ids_of('w')}) AS p,
  list_concat([1], {ids_of('w[1:30]')}) AS r FROM pieces)"""

SQL["chunk_copy_pair"] = (
    f"WITH {_PIECES} "
    + plan("t WHERE n = 31", seq="0", segment="'prompt'", input_ids="p")
    + " UNION ALL "
    + plan(
        "t WHERE n = 31",
        seq="1",
        segment="'repeat'",
        input_ids="r",
        labels="r",
        loss_mask=fill(1, "len(r)"),
        has_loss="1",
        loss_kind="'ce'",
        prefix_repeat="1",
        loss_denominator="len(r)",
    )
)

SQL["copy_pair_violations"] = f"""WITH {_PIECES} SELECT sample_id AS row_id,
  len(p)::BIGINT AS prompt_length, len(r)::BIGINT AS response_length FROM t WHERE n <> 31"""

_SHIFTED = f"""(SELECT row_id AS sample_id, i, list_concat(i[2:], [-100]) AS l, len(i) - 1 AS valid,
  row_id % 2 = 1 AS distill FROM ({lm_sample_rows(50, 512)}))"""
SQL["chunk_shifted"] = plan(
    chunked(_SHIFTED, 128, "l, valid, distill"),
    input_ids="c",
    labels="l[st + 1:st + 128]",
    loss_mask=fill(1, "len(c)"),
    has_loss="1",
    loss_kind="CASE WHEN distill THEN 'kl' ELSE 'ignore_index' END",
    forward_teacher="distill",
    loss_denominator="CASE WHEN distill THEN len(c) ELSE valid END",
)

_WHOLE = f"""w AS (SELECT sample_id, i[1:len(i) // 128 * 128] AS i FROM {_DOC_LISTS}),
f AS (SELECT sample_id, i, list_concat([2], i[1:len(i) - 1]) AS fed FROM w)"""
SQL["chunk_copy_back"] = (
    f"WITH {_WHOLE} "
    + plan(chunked("f", 128), input_ids="c")
    + " UNION ALL "
    + plan(
        chunked("f", 128, "i, fed"),
        seq="seq + len(i) // 128",
        segment="'repeat'",
        input_ids="fed[st + 1:st + 128]",
        labels="c",
        has_loss="1",
        loss_kind="'ignore_index'",
        loss_denominator="len(i)",
    )
)

_RANDOM = (
    "list_transform(range(0, 128), lambda k: "
    + draw("sample_id", "k", "42", "'random'")
    + " % 31999)"
)
SQL["chunk_mem_util"] = (
    plan(_DOC_LISTS, seq="0", input_ids="i[1:256]", forward_teacher="1")
    + " UNION ALL "
    + plan(
        _DOC_LISTS,
        seq="1",
        segment="'random'",
        input_ids=_RANDOM,
        loss_mask=fill(1, "128"),
        has_loss="1",
        loss_kind="'kl'",
        forward_teacher="1",
        do_not_compress="1",
        loss_denominator="128",
    )
)


def _news(books: str, slot: str, prefix: str, budget: str, place: str, width: str) -> str:
    """Contexts ``x`` and turns ``u`` of the news plans."""
    return f"""b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, t FROM ({books})),
s AS (SELECT d.doc_id AS sample_id, d.text, b.t AS noise_text,
    ({budget.replace('doc_id', 'd.doc_id')})::BIGINT AS budget
  FROM documents d JOIN b ON b.pos = ({slot.replace('doc_id', 'd.doc_id')}) % (SELECT count(*) FROM b)),
n AS (SELECT *, {ids('noise_text')} AS noise, {ids(f'{_lit(prefix)} || text')} AS story,
    {bos_ids(_lit(prefix))} AS pre FROM s),
r AS (SELECT *, budget - len(story) - len(pre) AS room FROM n),
e AS (SELECT *, noise[1:greatest(room, 0)] AS extra FROM r),
h AS (SELECT *, coalesce({place}, 0) AS spot FROM e),
x AS (SELECT sample_id, budget, CASE WHEN room > 0
    THEN list_concat(list_concat(list_concat(pre, extra[1:spot]), story), extra[spot + 1:])
    ELSE list_concat(pre, story)[1:budget] END AS i FROM h),
l AS (SELECT doc_id AS sample_id, string_split(text, chr(10)) AS l FROM documents),
q AS (SELECT sample_id, l, len(l) // 2 AS n, unnest(range(1, len(l) // 2 + 2)) AS t FROM l),
y AS (SELECT sample_id, n, t,
    CASE WHEN t <= n THEN {bos_ids("'Question: ' || l[2 * t - 1]")}
      ELSE {bos_ids(_lit(C.SUMMARY_REQUEST))} END AS ask,
    CASE WHEN t <= n THEN {bos_ids("'Answer: ' || l[2 * t]")} ELSE {bos_ids('l[len(l)]')} END AS reply
  FROM q),
z AS (SELECT y.*, list_concat(ask, reply)[1:{width}] AS c,
    list_concat({fill(0, 'len(ask)')}, {fill(1, 'len(reply)')})[1:{width}] AS m,
    (len(x.i) + 127) // 128 + t - 1 AS seq
  FROM y JOIN x ON x.sample_id = y.sample_id),
u AS (SELECT *, lag(least(len(c), 128)) OVER (PARTITION BY sample_id ORDER BY t) AS before FROM z)
"""


_LM = "sample_id % 2 = 0"
SQL["news_plan_v1"] = (
    "WITH "
    + _news(
        "SELECT doc_id, substr(text, 1, 131072) AS t FROM documents",
        "doc_id",
        C.NEWS_V1_PREFIX,
        f"({draw('doc_id', '42', repr('gain'))} % 4 + 1) * 128",
        f"CASE WHEN len(extra) > 0 THEN {draw('sample_id', '42', repr('place'))} % len(extra) END",
        "128",
    )
    + plan(chunked("x", 128), input_ids="c", forward_teacher=f"NOT ({_LM})")
    + " UNION ALL "
    + plan(
        f"(SELECT *, CASE WHEN {_LM} THEN m[2:] ELSE m END AS k FROM u)",
        segment="CASE WHEN t <= n THEN 'question' ELSE 'summary' END",
        input_ids="c",
        labels=f"(CASE WHEN {_LM} THEN c[2:] END)",
        loss_mask="k",
        has_loss="1",
        loss_kind=f"CASE WHEN {_LM} THEN 'ce' ELSE 'kl' END",
        forward_teacher=f"NOT ({_LM})",
        do_not_compress="1",
        clear_cache="before",
        loss_denominator=total("k"),
    )
)

SQL["news_plan_v2"] = (
    "WITH "
    + _news(
        "SELECT doc_id, substr(text, 1, 2000) AS t FROM documents WHERE length(text) >= 2000",
        draw("doc_id", "42", "'distractor'"),
        C.NEWS_V2_PREFIX,
        f"{draw('doc_id', '42', repr('budget'))} % 65 + 384",
        f"CASE WHEN len(extra) > 2 THEN {draw('sample_id', '42', repr('place'))} % (len(extra) - 2) + 1 END",
        "512 - x.budget",
    )
    + plan(chunked("x", 128), input_ids="c", forward_teacher="1")
    + " UNION ALL "
    + plan(
        "u",
        segment="CASE WHEN t <= n THEN 'question' ELSE 'summary' END",
        input_ids="c",
        labels="c[2:]",
        loss_mask="m",
        has_loss="1",
        loss_kind="'kl+ce'",
        forward_teacher="1",
        do_not_compress="1",
        clear_cache="before",
        loss_denominator=total("m"),
    )
)

SQL["catalog_news_plan"] = SQL["news_plan_v1"]

SQL["task_dispatch"] = f"""WITH d AS (SELECT row_id, lang, len(i) AS n FROM ({DOC_IDS})),
a AS (SELECT row_id, least(n, 512) AS n FROM d WHERE lang = 'en'),
b AS (SELECT row_id, least(512, n // 128 * 128) AS m FROM d WHERE lang <> 'en')
SELECT row_id AS sample_id, 'language modeling' AS task_type, ((n + 127) // 128)::BIGINT AS chunks,
  ((n + 127) // 128 - (n % 128 = 1)::BIGINT)::BIGINT AS scored_chunks, n::BIGINT AS tokens FROM a
UNION ALL
SELECT row_id, 'longdata copy', 2 * m // 128, m // 128, 2 * m FROM b WHERE m > 0"""

# --- joins, order, mixtures ------------------------------------------------

SQL["distractor_mod_join"] = """WITH b AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, substr(text, 1, 131072) AS t
  FROM documents)
SELECT d.doc_id + 7 AS row_id, md5(b.t) AS disturb
FROM documents d JOIN b ON b.pos = (d.doc_id + 7) % (SELECT count(*) FROM b)"""

SQL["distractor_random_join"] = f"""WITH b AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, substr(text, 1, 2000) AS t
  FROM documents WHERE length(text) >= 2000)
SELECT d.doc_id AS row_id, md5(b.t) AS disturb FROM documents d
JOIN b ON b.pos = {draw('d.doc_id', '42', "'distractor'")} % (SELECT count(*) FROM b)"""

SQL["task_cross_samples"] = """WITH t(task_id, task_type, task_name, num_instance, truncation) AS (
  VALUES (0, 'perplexity', 'documents', NULL, 512), (1, 'perplexity', 'documents', 100, 1024),
         (2, 'language modeling', 'documents', 10, NULL)),
d AS (SELECT doc_id AS row_id, lang, row_number() OVER (ORDER BY doc_id) AS row_no FROM documents)
SELECT task_name, row_id, lang, row_no, task_id::BIGINT AS task_id, task_type,
  num_instance::DOUBLE AS num_instance, truncation::DOUBLE AS truncation
FROM d CROSS JOIN t WHERE num_instance IS NULL OR row_no <= num_instance"""

SQL["shuffle_positions"] = """SELECT doc_id AS row_id,
  row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, 42)), doc_id) - 1 AS pos FROM documents"""

_MIXTURE = f"""steps AS (SELECT step, CASE WHEN {draw("'step'", 'step', '42')} / 4294967296.0 < 0.7
    THEN 'english' ELSE 'other' END AS name
  FROM (SELECT unnest(range(0, (SELECT count(*) // 2 FROM documents))) AS step)),
draws AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) - 1 AS pos FROM steps),
named AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS name
  FROM documents),
shuffled AS (SELECT *, row_number() OVER (PARTITION BY name
  ORDER BY md5(concat_ws('|', name, doc_id, 42)), doc_id) - 1 AS pos FROM named),
fed AS (SELECT step, d.name, d.pos, doc_id, text FROM draws d JOIN shuffled s
  ON s.name = d.name AND s.pos = d.pos)"""
SQL["mixture_feed"] = f"""WITH {_MIXTURE} SELECT step, name, pos, doc_id AS row_id, text,
  CASE WHEN name = 'english' THEN 512 END::DOUBLE AS truncation FROM fed"""


def _reservoir(source: str, doc: str, chunk: str, k: int) -> str:
    return f"""rs AS (SELECT *, CASE WHEN {chunk} < {k} THEN {chunk}
    ELSE {draw(doc, chunk, '42', "'slot'")} % ({chunk} + 1) END AS slot FROM {source}),
rn AS (SELECT *, max({chunk}) OVER (PARTITION BY {doc}) AS last_chunk,
    CASE WHEN slot < {k} THEN lead({chunk}) OVER (
      PARTITION BY {doc}, CASE WHEN slot < {k} THEN slot ELSE {k} + {chunk} END ORDER BY {chunk})
    END AS next_chunk FROM rs),
ro AS (SELECT *, CASE WHEN {chunk} = last_chunk THEN 'last'
    WHEN slot < {k} AND next_chunk IS NULL THEN 'kept' ELSE 'evicted' END AS outcome FROM rn),
rv AS (SELECT *, CASE WHEN outcome = 'kept' THEN row_number() OVER (
    PARTITION BY {doc}, outcome ORDER BY slot DESC) END AS visit FROM ro)"""


SQL["chunk_reservoir"] = f"""WITH d AS (SELECT sample_id AS row_id, seq AS chunk_id
  FROM {chunked(_DOC_LISTS, 32)}), {_reservoir('d', 'row_id', 'chunk_id', 2)}
SELECT row_id, chunk_id::BIGINT AS chunk_id, CASE WHEN slot < 2 THEN slot END::DOUBLE AS slot,
  outcome, CASE WHEN slot >= 2 THEN chunk_id WHEN outcome = 'evicted' THEN next_chunk
    END::DOUBLE AS released_at, visit::DOUBLE AS visit FROM rv"""

SQL["training_feed"] = f"""WITH {_MIXTURE},
en AS (SELECT step AS sample_id, ({bos_ids('text')})[1:512] AS i FROM fed WHERE name = 'english'),
oa AS (SELECT step AS sample_id, {bos_ids('text')} AS i FROM fed WHERE name = 'other'),
ob AS (SELECT sample_id, i[1:len(i) // 128 * 128] AS i FROM oa),
oc AS (SELECT sample_id, i, list_concat([2], i[1:len(i) - 1]) AS fed FROM ob),
p AS (
  SELECT sample_id, seq, 'context' AS segment, c, len(c) > 1 AS has_loss FROM {chunked('en', 128)}
  UNION ALL SELECT sample_id, seq, 'context', c, false FROM {chunked('oc', 128)}
  UNION ALL SELECT sample_id, seq + len(i) // 128, 'repeat', fed[st + 1:st + 128], true
    FROM {chunked('oc', 128, 'i, fed')}),
{_reservoir('p', 'sample_id', 'seq', 2)}
SELECT sample_id AS step, seq::BIGINT AS seq, segment, {join('c')} AS input_ids,
  has_loss::BIGINT AS has_loss, outcome, visit::DOUBLE AS visit FROM rv"""

# --- scores ----------------------------------------------------------------

SQL["token_nll"] = f"WITH {LOGITS} SELECT vec_id, round(nll, 6) AS nll FROM scored"

SQL["shifted_nll"] = f"""WITH {LOGITS} SELECT a.sample_id, a.pos,
  round(CASE WHEN b.label = -100 THEN 0.0 ELSE a.z - a.e[b.label + 1] END, 6) AS nll
FROM lse a JOIN lse b ON b.sample_id = a.sample_id AND b.pos = a.pos + 1"""

SQL["softmax_rows"] = f"""WITH {LOGITS} SELECT vec_id,
  {join('list_transform(e, lambda x: round(exp(x - z) * 1e6)::BIGINT)')} AS probs FROM lse"""

SQL["minmax_rows"] = f"""WITH {LOGITS} SELECT vec_id, {join(
    'list_transform(e, lambda x: round((x - list_min(e)) / (list_max(e) - list_min(e)) * 1e6)::BIGINT)'
)} AS scaled FROM lse"""

SQL["ce_prefix_mask"] = f"""WITH {LOGITS},
s AS (SELECT sample_id, pos, mask, z - e[gold + 1] AS nll FROM lse),
f AS (SELECT *, min(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY sample_id) AS first FROM s)
SELECT sample_id, round(sum(CASE WHEN pos >= first THEN nll ELSE 0 END) / nullif(sum(mask), 0), 6) AS loss
FROM f GROUP BY sample_id"""

SQL["ce_ignore_index"] = f"""WITH {LOGITS}, g AS (
  SELECT sample_id, sum(nll) AS s, sum((label <> -100)::BIGINT) AS n FROM scored GROUP BY sample_id
  UNION ALL SELECT NULL, sum(nll), sum((label <> -100)::BIGINT) FROM scored)
SELECT sample_id::DOUBLE AS sample_id, round(CASE WHEN n > 0 THEN s / n WHEN sample_id IS NULL THEN s ELSE 0 END, 6) AS loss,
  round(s, 6) AS loss_sum, n::BIGINT AS valid FROM g"""

SQL["chunk_loss_sum"] = f"""WITH {LOGITS} SELECT sample_id, round(sum(nll) / 10, 6) AS loss,
  sum((label <> -100)::BIGINT)::BIGINT AS valid FROM scored GROUP BY sample_id"""

_TWO_SIDES = f"""{LOGITS},
sides AS (SELECT a.*, b.e AS se, b.z AS sz FROM lse a JOIN lse b ON b.vec_id = a.vec_id + 1),
div AS (SELECT *, list_sum(list_transform(range(1, len(e) + 1),
    lambda k: exp(e[k] - z) * ((e[k] - z) - (se[k] - sz)))) AS kl,
  list_sum(list_transform(range(1, len(e) + 1),
    lambda k: (e[k] - se[k]) * (e[k] - se[k]))) AS sq FROM sides)"""

SQL["kl_masked"] = f"""WITH {_TWO_SIDES} SELECT sample_id, round(avg(kl), 6) AS kl
  FROM (SELECT sample_id, CASE WHEN mask = 1 THEN kl END AS kl FROM div) GROUP BY sample_id"""

SQL["mse_masked"] = f"""WITH {_TWO_SIDES} SELECT sample_id,
  round(sum(CASE WHEN mask = 1 THEN sq ELSE 0 END) / sum(len(e)), 6) AS mse
  FROM div GROUP BY sample_id"""

SQL["blended_loss"] = f"""WITH {_TWO_SIDES},
c AS (SELECT *, CASE WHEN label = -100 THEN 0.0 ELSE sz - se[label + 1] END AS nll,
  min(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY sample_id) AS first FROM div),
g AS (SELECT sample_id, avg(CASE WHEN mask = 1 THEN kl END) AS kl,
  sum(CASE WHEN pos >= first THEN nll ELSE 0 END) / nullif(sum(mask), 0) AS ce
  FROM c GROUP BY sample_id)
SELECT sample_id, round(0.9 * kl + 0.1 * ce, 6) AS loss FROM g"""

_BIGRAMS = f"""pairs AS (SELECT sample_id, p, i[p] AS prev, i[p + 1] AS tok
  FROM (SELECT sample_id, i, unnest(range(1, len(i))) AS p FROM {_DOC_LISTS}) WHERE p % 128 <> 0),
n2 AS (SELECT prev, tok, count(*) AS n FROM pairs GROUP BY prev, tok),
n1 AS (SELECT prev, sum(n) AS n FROM n2 GROUP BY prev),
v AS (SELECT count(*) AS v FROM (SELECT prev FROM n2 UNION SELECT tok FROM n2)),
lp AS (SELECT sample_id, p, ln((n2.n + 1) / (n1.n + v.v)) AS lp
  FROM pairs JOIN n2 USING (prev, tok) JOIN n1 USING (prev) CROSS JOIN v)"""

SQL["bigram_perplexity"] = f"""WITH {_BIGRAMS} SELECT sample_id, NULL::DOUBLE AS truncation,
  count(*)::BIGINT AS scored_tokens, round(exp(-avg(lp)), 6) AS perplexity FROM lp GROUP BY sample_id"""

SQL["ppl_report"] = f"""WITH {_BIGRAMS},
t(task_id, truncation) AS (VALUES (0, 128), (1, 256), (2, 512), (3, 1024), (4, NULL)),
s AS (SELECT task_id, truncation, d.doc_id AS sample_id, exp(-avg(lp)) AS ppl FROM documents d CROSS JOIN t
  LEFT JOIN lp ON lp.sample_id = d.doc_id AND (truncation IS NULL OR p < truncation) GROUP BY task_id, truncation, d.doc_id)
SELECT task_id::BIGINT AS task_id, 'documents' AS task_name, 'perplexity' AS task_type,
  NULL::DOUBLE AS num_instance, truncation::DOUBLE AS truncation, 128::BIGINT AS chunk_size,
  count(ppl)::BIGINT AS samples, count(*) FILTER (ppl IS NULL)::BIGINT AS unscored, round(avg(ppl), 6) AS avg,
  round(max(ppl), 6) AS max, round(min(ppl), 6) AS min FROM s GROUP BY task_id, truncation"""

SQL["external_scorer"] = f"""SELECT sample_id, count(*)::BIGINT AS scored_tokens,
  round(exp(avg(CASE WHEN tok % 2 = 1 THEN 0.5 ELSE 1.5 END)), 6) AS perplexity
FROM (SELECT sample_id, p, i[p + 1] AS tok
  FROM (SELECT sample_id, i, unnest(range(1, len(i))) AS p FROM {_DOC_LISTS}) WHERE p % 128 <> 0)
GROUP BY sample_id"""

SQL["first_result"] = f"""WITH {LOGITS} SELECT sample_id, round(arg_min(nll, pos), 6) AS result
  FROM scored WHERE label <> -100 GROUP BY sample_id"""

SQL["copy_report"] = f"""WITH {LOGITS},
f AS (SELECT sample_id, arg_min(nll, pos) AS result FROM scored WHERE label <> -100 GROUP BY sample_id),
n AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS row_no FROM f),
t(task_id, num_instance) AS (VALUES (0, NULL), (1, 10))
SELECT task_id::BIGINT AS task_id, 'copies' AS task_name, 'auto encoding' AS task_type,
  num_instance::DOUBLE AS num_instance, NULL::DOUBLE AS truncation, 128::BIGINT AS chunk_size,
  count(*)::BIGINT AS samples, round(avg(result), 6) AS avg, round(max(result), 6) AS max,
  round(min(result), 6) AS min
FROM n JOIN t ON num_instance IS NULL OR row_no <= num_instance GROUP BY task_id, num_instance"""

# --- batches ---------------------------------------------------------------

_BATCHES = f"""s AS ({lm_sample_rows(50, 512)}),
o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', row_id, 42)), row_id) - 1 AS pos FROM s),
b AS (SELECT *, pos // 8 AS batch_id, pos % 8 AS place,
  max(len(i)) OVER (PARTITION BY pos // 8) - len(i) AS gap FROM o)"""


SQL["pad_batches"] = f"""WITH {_BATCHES} SELECT batch_id::BIGINT AS batch_id, place::BIGINT AS place,
  row_id, len(i)::BIGINT AS length, row_id AS index,
  {join(f"list_concat(i, {fill(0, 'gap')})")} AS input_ids,
  {join(f"list_concat(i, {fill(-100, 'gap')})")} AS labels,
  {join(f"list_concat({fill(1, 'len(i)')}, {fill(0, 'gap')})")} AS attention_mask FROM b"""

def _padded_chunks(part: str, value: int) -> str:
    """Slices of 128 of ``i`` as ``part`` makes them, padded to ``m``, one after the other."""
    return join(
        f"""flatten(list_transform(range(0, n), lambda c: list_concat({part},
  list_transform(range(0, m - least(128, len(i) - 128 * c)), lambda k: {value}))))"""
    )


SQL["pad_nested"] = f"""WITH {_BATCHES}, w AS (SELECT *, (len(i) + 127) // 128 AS n,
  max(least(len(i), 128)) OVER (PARTITION BY batch_id) AS m FROM b)
SELECT row_id, batch_id::BIGINT AS batch_id, n::BIGINT AS n,
  {_padded_chunks('i[128 * c + 1 : 128 * c + 128]', 0)} AS chunks,
  {_padded_chunks('i[128 * c + 1 : 128 * c + 128]', -100)} AS chunk_label_ids,
  {_padded_chunks('list_transform(i[128 * c + 1 : 128 * c + 128], lambda x: 1)', 0)} AS chunk_attention_mask,
  {_padded_chunks('range(0, least(128, len(i) - 128 * c))', 0)} AS chunk_position_ids FROM w"""

SQL["stacked_batches"] = f"""WITH {_BATCHES}
SELECT batch_id::BIGINT AS batch_id, string_agg(row_id::VARCHAR, ',' ORDER BY place) AS row_id,
  max(len(i))::BIGINT AS longest,
  string_agg({join(f"list_concat(i, {fill(0, 'gap')})")}, ',' ORDER BY place) AS input_ids
FROM b GROUP BY batch_id"""

SQL["position_ids"] = f"""WITH {_BATCHES},
x AS (SELECT row_id, batch_id, list_concat({fill(0, 'gap')}, i) AS i,
  list_concat({fill(0, 'gap')}, range(0, len(i))) AS position_ids FROM b),
y AS (SELECT row_id, unnest(i) AS x, generate_subscripts(i, 1) AS k FROM x),
c AS (SELECT row_id, k, CASE WHEN x % 3 = 0 THEN 0 ELSE sum((x % 3 <> 0)::BIGINT)
  OVER (PARTITION BY row_id ORDER BY k) - 1 END AS h FROM y),
h AS (SELECT row_id, string_agg(h::BIGINT::VARCHAR, ',' ORDER BY k) AS with_holes FROM c GROUP BY row_id)
SELECT row_id, batch_id::BIGINT AS batch_id, {join('position_ids')} AS position_ids, with_holes
FROM x JOIN h USING (row_id)"""

# --- context ---------------------------------------------------------------

_ARRIVALS = f"a AS (SELECT conv_id, turn, role, {ids('text')} AS i FROM conversations)"

SQL["context_state"] = f"""WITH {_ARRIVALS}, s AS (SELECT conv_id, turn, len(i) AS n,
  sum(len(i)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS total FROM a)
SELECT conv_id, turn, n::BIGINT AS n_tokens, total AS total_tokens, total // 64 AS chunks_done,
  total % 64 AS tail FROM s"""

SQL["emitted_chunks"] = f"""WITH {_ARRIVALS},
f AS (SELECT conv_id AS sample_id, flatten(list(i ORDER BY turn)) AS i FROM a GROUP BY conv_id)
SELECT sample_id AS conv_id, seq::BIGINT AS chunk_id, {join('c')} AS input_ids
FROM {chunked('f', 64)} WHERE len(c) = 64"""

SQL["stream_chunk_emit"] = SQL["emitted_chunks"]

SQL["stream_gaps"] = f"""WITH {_ARRIVALS},
l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM a),
p AS (SELECT conv_id, turn, i, lag(turn, 1, -1) OVER k AS prev,
  sum(len(i)) OVER k AS upto FROM l WHERE turn % 3 <> 1 OR turn = last WINDOW k AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, flatten(list(i ORDER BY turn)) AS i FROM p GROUP BY conv_id),
c AS (SELECT conv_id, chunk_id, i[64 * chunk_id + 1 : 64 * chunk_id + 64] AS c
  FROM (SELECT *, unnest(range(0, len(i) // 64)) AS chunk_id FROM f))
SELECT c.conv_id, 'chunk' AS kind, c.chunk_id::BIGINT AS chunk_id, min(p.turn)::BIGINT AS turn, {join('any_value(c.c)')} AS input_ids
FROM c JOIN p ON p.conv_id = c.conv_id AND p.upto >= 64 * (c.chunk_id + 1) GROUP BY c.conv_id, c.chunk_id
UNION ALL SELECT conv_id, 'gap', turn - prev - 1, prev + 1, NULL FROM p WHERE turn - prev > 1"""

SQL["stream_reset"] = f"""WITH {_ARRIVALS},
f AS (SELECT conv_id, max(turn) AS turn, flatten(list(i ORDER BY turn)) AS i FROM a GROUP BY conv_id)
SELECT conv_id, (len(i) // 64)::BIGINT AS chunks, turn::BIGINT AS turn,
  {join('i[64 * (len(i) // 64) + 1 :]')} AS tail FROM f"""

# --- vectors ---------------------------------------------------------------

_CELLS = """SELECT label::BIGINT AS label, vec_id, unnest(embedding::DOUBLE[]) AS x,
  (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos FROM embeddings"""

SQL["vector_mix"] = f"""SELECT label, pos, round(avg(x), 6) AS value FROM ({_CELLS})
  GROUP BY label, pos"""

SQL["vector_mix_weighted"] = f"""SELECT label, pos, round(sum((vec_id % 5 + 1) / 10.0 * x), 6) AS value
  FROM ({_CELLS}) GROUP BY label, pos"""

SQL["vector_agreement"] = """SELECT conv_id FROM conversations GROUP BY conv_id
  HAVING min(role) <> max(role)"""

SQL["norm_report"] = """WITH n AS (SELECT vec_id, label,
    sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS p FROM embeddings),
r AS (SELECT a.label, coalesce(b.p, 0) AS g, coalesce(b.p, 0) / (a.p + 1e-6) AS r
  FROM n a LEFT JOIN n b ON b.vec_id = a.vec_id + 1)
SELECT label::BIGINT AS label, round(avg(g), 6) AS avg_norm, round(max(g), 6) AS max_norm,
  round(avg(r), 6) AS avg_ratio, round(max(r), 6) AS max_ratio FROM r GROUP BY label"""
