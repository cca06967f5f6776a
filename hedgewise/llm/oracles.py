"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from hedgewise.llm import interaction
from hedgewise.llm.decontam import WINDOW
from hedgewise.llm.licenses import AGREE, BASE, KEYS, RARE, SEPARATORS, TEMPLATES
from hedgewise.llm.queries import ORACLES
from hedgewise.llm.quotes import ANNOUNCED, MARKS, QUOTED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


ORACLES["op6_odd_sketches"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT y, other FROM reached JOIN links ON x = reached.doc_id
), c AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

ORACLES["op8_positional_index"] = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM benchmark
), tok AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM d),
win AS (
  SELECT row_number() OVER () AS win, item_id, ws FROM (
    SELECT DISTINCT item_id, unnest(list_transform(range(1, 1 + greatest(len(ws) - {WINDOW - 1}, least(len(ws), 1))), lambda k: ws[k:k + {WINDOW - 1}])) AS ws FROM i)
), wt AS (SELECT win, item_id, len(ws) AS size, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS off FROM win),
freq AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
anchor AS (
  SELECT win, item_id, size, wt.term, off FROM wt LEFT JOIN freq ON freq.term = wt.term
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), off) = 1
), cand AS (SELECT win, item_id, size, doc_id, pos, pos - off AS start FROM anchor JOIN tok ON tok.term = anchor.term),
exact AS (
  SELECT c.win, c.item_id, c.doc_id, c.start, c.size FROM cand c JOIN wt ON wt.win = c.win
  JOIN tok ON tok.doc_id = c.doc_id AND tok.term = wt.term AND tok.pos = c.start + wt.off
  GROUP BY ALL HAVING count(*) = c.size
), kinds AS (SELECT win, count(DISTINCT term) AS kinds FROM wt GROUP BY win),
near AS (
  SELECT c.doc_id, c.win, c.pos, kinds FROM cand c JOIN kinds ON kinds.win = c.win JOIN wt ON wt.win = c.win
  JOIN tok ON tok.doc_id = c.doc_id AND tok.term = wt.term AND tok.pos BETWEEN c.pos - {2 * WINDOW} AND c.pos + {2 * WINDOW}
  GROUP BY ALL HAVING count(DISTINCT wt.term) = kinds
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM exact) GROUP BY doc_id),
reach AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT near.doc_id, unnest(range(greatest(pos - {2 * WINDOW}, 0), least(pos + {2 * WINDOW} + 1, len(ws)))) AS p FROM near JOIN d ON d.doc_id = near.doc_id)
  GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM exact) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated, coalesce(reach.n, 0) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_TEMPLATES = ", ".join(
    f"({t}, {_text(label)}, {_texts(text.split())}, {_texts(phrases)})" for t, (label, text, phrases) in enumerate(TEMPLATES)
)
_BASE = " UNION ALL ".join(
    f"SELECT a.doc_id, a.pos, {_text(label)} AS label FROM tok a"
    + "".join(
        f" JOIN tok t{k} ON t{k}.doc_id = a.doc_id AND t{k}.pos = a.pos + {k} AND t{k}.word = {_text(w)}"
        for k, w in enumerate(phrase.split())
        if k
    )
    + f" WHERE a.word = {_text(phrase.split()[0])}"
    for label, phrase in BASE.items()
)

ORACLES["op10_rare_licence_words"] = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM documents
), tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
t(template, label, wording, phrases) AS (VALUES {_TEMPLATES}),
post AS (SELECT template, unnest(wording) AS word, generate_subscripts(wording, 1) - 1 AS place FROM t),
vocabulary AS (SELECT DISTINCT word FROM post),
files AS (SELECT word, count(DISTINCT doc_id) AS files FROM tok SEMI JOIN vocabulary USING (word) GROUP BY word),
opened AS (SELECT doc_id, ws FROM d WHERE list_has_any(ws, {_texts(KEYS)})),
rare AS (
  SELECT doc_id, word FROM (SELECT DISTINCT doc_id, word FROM tok SEMI JOIN opened USING (doc_id)) JOIN files USING (word)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY files.files, word) <= {RARE}
), votes AS (
  SELECT tok.doc_id, template, pos - place AS shift, count(*) AS votes FROM tok JOIN rare ON rare.doc_id = tok.doc_id AND rare.word = tok.word
  JOIN post ON post.word = tok.word GROUP BY ALL
), best AS (
  SELECT doc_id, template, shift FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY votes DESC, shift) = 1
), shares AS (
  SELECT best.doc_id, best.template, count(tok.pos) AS agree FROM best JOIN post ON post.template = best.template
  LEFT JOIN tok ON tok.doc_id = best.doc_id AND tok.pos = shift + place AND tok.word = post.word GROUP BY ALL
), judged AS (
  SELECT shares.doc_id, label, agree / len(wording) AS share FROM shares JOIN t ON t.template = shares.template JOIN opened ON opened.doc_id = shares.doc_id
  WHERE agree / len(wording) >= {AGREE}
    AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || p || ' '))) = 0
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM judged GROUP BY doc_id),
places AS ({_BASE}),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  coalesce(more.score, 0.0) AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id
"""

ORACLES["op4_quotation_links"] = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, CASE WHEN text IS NULL THEN NULL ELSE regexp_replace(array_to_string(
    list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{QUOTED}') AND NOT regexp_matches(x, '{ANNOUNCED}')), chr(10)),
    '^\s+|\s+$', '', 'g') END AS body
  FROM conversations
), line AS (
  SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM m WHERE regexp_matches(text, '(?m){QUOTED}'))
), deep AS (
  SELECT * REPLACE (regexp_replace(content, '{MARKS}', '') AS content),
    length(regexp_replace(regexp_extract(content, '{MARKS}', 1), '[^>]', '', 'g')) AS depth FROM line
), step AS (
  SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY conv_id, turn, role, text ORDER BY line) = depth THEN 0 ELSE 1 END AS starts FROM deep
), run AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn, role, text ORDER BY line) AS run FROM step),
quoted AS (
  SELECT conv_id, turn, role, text, min(line) AS first_line, min(depth) AS depth,
    trim(regexp_replace(lower(string_agg(content, ' ' ORDER BY line)), '\s+', ' ', 'g')) AS passage
  FROM run WHERE depth > 0 GROUP BY conv_id, turn, role, text, run
), part AS (
  SELECT conv_id, turn, unnest(list_transform(list_concat([body], string_split_regex(body, '\n\s*\n'), string_split(body, chr(10))),
    lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g')))) AS passage
  FROM m WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL
), original AS (SELECT passage, conv_id, min(turn) AS turn FROM part WHERE passage <> '' GROUP BY passage, conv_id),
earliest AS (SELECT passage, conv_id, turn FROM original QUALIFY row_number() OVER (PARTITION BY passage ORDER BY conv_id, turn) = 1),
matched AS (
  SELECT q.*, CASE WHEN o.turn < q.turn THEN o.turn END AS reply_to,
    CASE WHEN e.conv_id <> q.conv_id THEN e.conv_id END AS source_conv, CASE WHEN e.conv_id <> q.conv_id THEN e.turn END AS source_turn
  FROM quoted q LEFT JOIN original o ON o.passage = q.passage AND o.conv_id = q.conv_id LEFT JOIN earliest e ON e.passage = q.passage
  WHERE q.passage <> ''
), reply AS (
  SELECT conv_id, turn, role, text, count(*) AS n_passages, count(*) FILTER (reply_to IS NOT NULL OR source_conv IS NOT NULL) AS n_linked,
    arg_min(reply_to, depth * 1000000000 + first_line) FILTER (reply_to IS NOT NULL) AS reply_to,
    arg_min(source_conv, depth * 1000000000 + first_line) FILTER (source_conv IS NOT NULL) AS source_conv,
    arg_min(source_turn, depth * 1000000000 + first_line) FILTER (source_conv IS NOT NULL) AS source_turn
  FROM matched GROUP BY conv_id, turn, role, text
), edge AS (SELECT conv_id, turn, min(reply_to) AS top FROM reply WHERE reply_to IS NOT NULL GROUP BY conv_id, turn),
path(conv_id, turn, path) AS (
  SELECT conv_id, turn, lpad(CAST(top AS VARCHAR), 10, '0') FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge u WHERE u.conv_id = e.conv_id AND u.turn = e.top)
  UNION SELECT e.conv_id, e.turn, p.path || '/' || lpad(CAST(e.top AS VARCHAR), 10, '0') FROM path p JOIN edge e ON e.conv_id = p.conv_id AND e.top = p.turn
)
SELECT m.conv_id, m.turn, m.role, body, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, reply_to, source_conv, source_turn,
  CASE WHEN n_passages IS NULL OR path IS NULL THEN 0 ELSE len(string_split(path, '/')) END AS depth,
  concat_ws('/', CASE WHEN n_passages IS NOT NULL THEN path END, lpad(CAST(m.turn AS VARCHAR), 10, '0')) AS reply_path
FROM m LEFT JOIN reply r ON r.conv_id = m.conv_id AND r.turn = m.turn AND r.role IS NOT DISTINCT FROM m.role AND r.text = m.text
LEFT JOIN path p ON p.conv_id = m.conv_id AND p.turn = m.turn
"""

ORACLES["op11_filter_interaction"] = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{
    'A': len(ws) < {interaction.FEW_WORDS},
    'B': 100 * len(list_distinct(ws)) < {interaction.DISTINCT_PERCENT} * len(ws),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {interaction.CAPITAL_PERCENT} * length(text),
    'D': regexp_matches(text, '{interaction.SYMBOLS}'),
    'E': EXISTS (SELECT 1 FROM t o WHERE o.text = w.text AND o.doc_id < w.doc_id)
  }} AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), f AS (SELECT unnest(string_split('A B C D E', ' ')) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), combos AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: struct_extract(fails, 'A') AND x = 'A' OR struct_extract(fails, 'B') AND x = 'B'
    OR struct_extract(fails, 'C') AND x = 'C' OR struct_extract(fails, 'D') AND x = 'D' OR struct_extract(fails, 'E') AND x = 'E') AS failed,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d GROUP BY ALL
), steps AS (
  SELECT part, filter_order, step, n, good, toxic, failed, substr(filter_order, step, 1) AS own,
    list_has_any(failed, list_filter(string_split(filter_order, ''), lambda x, i: i < step)) AS earlier
  FROM combos, orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    coalesce(sum(n) FILTER (NOT earlier AND NOT list_contains(failed, own)), 0) AS kept,
    coalesce(sum(n) FILTER (NOT earlier AND list_contains(failed, own)), 0) AS removed,
    coalesce(sum(n) FILTER (earlier AND list_contains(failed, own)), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = [own]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT earlier AND list_contains(failed, own)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT earlier AND list_contains(failed, own)), 0) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
