"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

#: The domain tables as common table expressions; each names those it needs.
VIEWS: dict[str, tuple[list[str], str]] = {
    "candidates": ([], r"""SELECT event_id AS fact_id, user_id AS person_id, event_type AS attribute, event_type || ' value ' || regexp_extract(props, '"k": *([0-9]+)', 1) AS claim,
        (event_id % 100) * 10 + event_id % 5 AS source_utterance_id, ts AS valid_from, value AS weight FROM events"""),
    "facts": (["candidates"], """SELECT * EXCLUDE (prev, n), lead(fact_id) OVER w AS superseded_by, lead(valid_from) OVER w AS superseded_at
        FROM (SELECT *, lag(claim) OVER v AS prev, row_number() OVER v AS n FROM candidates WINDOW v AS (PARTITION BY person_id, attribute ORDER BY valid_from, fact_id))
        WHERE n = 1 OR prev IS DISTINCT FROM claim WINDOW w AS (PARTITION BY person_id, attribute ORDER BY valid_from, fact_id)"""),
    "people": ([], "SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS relationship, c_custkey = 0 AS is_owner, 1700000000000 + ((c_custkey * 7919) % 1000) * 1000 AS created_ms FROM customer"),
    "promises": ([], """SELECT o_orderkey AS promise_id, o_custkey AS person_id,
        lower(substr(o_orderpriority, 3)) || CASE WHEN o_orderkey % 50 = 0 THEN ' purchase' ELSE ' call' END || ' for Customer#' || lpad(((o_custkey + 1) % 1500)::VARCHAR, 9, '0') AS text,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'cancelled' END AS status,
        CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderdate END AS due_at, o_orderdate - INTERVAL 10 DAY AS created_at FROM orders"""),
    "utterances": ([], """SELECT conv_id * 10 + turn AS utterance_id, conv_id AS conversation_id, turn, role AS speaker,
        CASE WHEN turn % 7 = 6 THEN NULL WHEN role = 'assistant' THEN 0 ELSE (conv_id * 7 + turn) % 150 END AS person_id, text,
        (sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) * 60)::BIGINT AS start_ms,
        (sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS end_ms, turn <> max(turn) OVER (PARTITION BY conv_id) AS is_final FROM conversations"""),
    "segments": (["utterances"], "SELECT * FROM (SELECT conversation_id, speaker, start_ms, end_ms - (turn % 3) * 200 AS end_ms FROM utterances) WHERE end_ms > start_ms"),
    "words": (["utterances"], r"""SELECT conversation_id, utterance_id, position, text, a + (2 * (b - a) * (upto - length(text)) + total) // (2 * total) AS start_ms, a + (2 * (b - a) * upto + total) // (2 * total) AS end_ms FROM (
        SELECT conversation_id, utterance_id, a, b, position, text, sum(length(text)) OVER (PARTITION BY conversation_id, utterance_id) ::BIGINT AS total, (sum(length(text)) OVER (PARTITION BY conversation_id, utterance_id ORDER BY position))::BIGINT AS upto FROM (
        SELECT conversation_id, utterance_id, start_ms AS a, end_ms AS b, unnest(ws) AS text, unnest(range(len(ws))) AS position FROM (
        SELECT *, regexp_extract_all(text, '[^\s]+') AS ws FROM utterances)))"""),
    "labelled": (["words", "segments"], """SELECT w.*, coalesce((SELECT min_by(s.speaker, s.start_ms) FROM segments s WHERE s.conversation_id = w.conversation_id
        AND w.start_ms + w.end_ms >= 2 * s.start_ms AND w.start_ms + w.end_ms < 2 * s.end_ms), 'unknown') AS speaker FROM words w"""),
    "voiceprints": ([], "SELECT vec_id AS voiceprint_id, label::BIGINT AS person_id, embedding::DOUBLE[] AS embedding, 500 + (vec_id * 37) % 6000 AS duration_ms FROM embeddings"),
    "trials": ([], "SELECT l.doc_id AS trial_id, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality = 1 AS genuine, lang AS block FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "pairs": (["facts"], """SELECT o.fact_id AS before_id, o.claim AS before_claim, o.source_utterance_id AS before_source, o.superseded_by AS change_id, o.superseded_at,
        n.person_id, n.attribute, n.claim AS after_claim, n.source_utterance_id AS after_source, n.valid_from FROM facts o JOIN facts n ON o.superseded_by = n.fact_id"""),
    "heard": (["utterances"], """SELECT s.utterance_id, s.conversation_id, list_sort(coalesce(list(DISTINCT u.person_id) FILTER (u.person_id IS NOT NULL), [])) AS people
        FROM utterances s LEFT JOIN utterances u ON u.conversation_id = s.conversation_id AND u.is_final AND u.end_ms <= s.end_ms AND u.person_id IS NOT NULL GROUP BY s.utterance_id, s.conversation_id"""),
    "cos": (["voiceprints"], """SELECT q.voiceprint_id AS query_id, v.voiceprint_id, v.person_id, round(list_dot_product(q.embedding, v.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding))), 12) AS cosine
        FROM voiceprints q JOIN voiceprints v ON q.voiceprint_id % 50 = 0"""),
    "every_cos": (["voiceprints"], """SELECT q.voiceprint_id AS query_id, v.voiceprint_id, v.person_id, round(list_dot_product(q.embedding, v.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding))), 12) AS cosine
        FROM voiceprints q CROSS JOIN voiceprints v"""),
}


def with_views(body: str, *names: str) -> str:
    """The body after the expressions it needs, in order of need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in VIEWS[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    recursive = body.lstrip().startswith("RECURSIVE")
    body = body.lstrip().removeprefix("RECURSIVE").lstrip()
    if body.startswith(","):
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"
    return f"WITH {ctes}\n{body}" if ctes else body
