"""DuckDB statements that answer the registered queries from the same tables.

`VIEWS` holds the evidence rules of `worktide.demo.evidence`, `SHARED` the
derived relations several statements need, `STATEMENTS` one body per query.
"""

from __future__ import annotations

import re

TZ = "America/Toronto"


def day_of(ts: str) -> str:
    return f"CAST(timezone('{TZ}', timezone('UTC', {ts})) AS DATE)"


def us_day(us: str) -> str:
    return day_of(f"make_timestamp({us})")


def midnight_us(day: str) -> str:
    return f"epoch_us(timezone('{TZ}', CAST({day} AS TIMESTAMP)))"


VIEWS: dict[str, str] = {
    "ev": """
        SELECT event_id, ts, user_id, event_type,
               CAST(round(value * 100) AS BIGINT) AS cents,
               CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
               epoch_us(ts) AS us,
               'u' || user_id AS session_id,
               lpad(CAST(event_id AS VARCHAR), 12, '0') AS turn_id
        FROM events""",
    "sessions": """
        SELECT 'u' || user_id AS id,
               '/' || (SELECT event_type FROM ev k WHERE k.user_id = u.user_id
                       GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS cwd,
               'User ' || user_id AS title, created, updated,
               user_id % 4 = 0 AS archived,
               CASE WHEN user_id = 1 THEN 'u2' WHEN user_id = 2 THEN 'u3'
                    WHEN user_id = 3 THEN 'u2'
                    WHEN user_id % 37 = 0 AND user_id > 0 THEN 'u' || (10000000 + user_id)
                    WHEN user_id % 5 IN (0, 1) AND user_id > 1 THEN 'u' || (user_id - 1)
               END AS parent_id,
               CASE WHEN user_id % 7 = 0 THEN ['no_title'] ELSE CAST([] AS VARCHAR[]) END
                   AS quality
        FROM (SELECT user_id, min(us) AS created, max(us) AS updated FROM ev GROUP BY user_id) u""",
    "turns": """
        SELECT session_id, turn_id AS id, '/' || event_type AS cwd, us AS s,
               CASE WHEN event_id % 17 <> 0 THEN us + cents * 6000000 END AS e,
               CASE WHEN event_id % 17 = 0
                    THEN ['historical_upper_bound', 'unfinished_observed_only']
                    ELSE ['historical_upper_bound'] END AS quality,
               CASE WHEN event_id % 17 = 0 THEN 60.0 ELSE 0.0 END AS uncertainty
        FROM ev""",
    "coverage": """
        SELECT session_id, turn_id, us AS s, us + k * 60000000 AS e
        FROM ev WHERE event_id % 17 = 0 AND k > 0""",
    "waits": """
        SELECT * FROM (
            SELECT session_id, turn_id, least(us + k * 10000000, us + cents * 6000000) AS s,
                   least(us + k * 10000000 + 300000000, us + cents * 6000000) AS e
            FROM ev WHERE event_type = 'error') WHERE e > s""",
    "contexts": """
        SELECT session_id, turn_id, us AS at_us, 'm' || (event_id % 4) AS model_id,
               ['low', 'medium', 'high'][event_id % 3 + 1] AS reasoning_level
        FROM ev WHERE event_id % 13 <> 0
        UNION ALL
        SELECT session_id, turn_id, us + cents * 3000000, 'm' || ((event_id + 1) % 4),
               ['low', 'medium', 'high'][event_id % 3 + 1]
        FROM ev WHERE event_id % 3 = 0
        UNION ALL
        SELECT session_id, turn_id, us, 'm9', ['low', 'medium', 'high'][event_id % 3 + 1]
        FROM ev WHERE event_id % 11 = 0""",
    "quota": """
        SELECT DISTINCT CASE WHEN r.used = 99 THEN us + 1000000 ELSE us END AS at_us,
               'primary' AS bucket, r.resets AS resets_at, r.used AS used
        FROM (SELECT us, unnest([
                  struct_pack(resets := resets, used := low),
                  CASE WHEN event_id % 211 = 0
                       THEN struct_pack(resets := resets, used := low + 1) END,
                  CASE WHEN event_id % 43 = 0 AND ts >= TIMESTAMP '2024-01-08'
                       THEN struct_pack(resets := resets - 604800, used := CAST(99 AS DOUBLE))
                       END]) AS r
              FROM (SELECT *, epoch(week)::BIGINT + 604800 + event_id % 7 AS resets,
                           CASE WHEN event_id % 19 = 0 THEN greatest(floor(100 * rn / n) - 5, 0)
                                ELSE floor(100 * rn / n) END AS low
                    FROM (SELECT *, date_trunc('week', ts) AS week,
                                 row_number() OVER (PARTITION BY date_trunc('week', ts)
                                                    ORDER BY ts, event_id) AS rn,
                                 count(*) OVER (PARTITION BY date_trunc('week', ts)) AS n
                          FROM ev WHERE event_type = 'purchase')))
        WHERE r IS NOT NULL""",
    # --- derived -----------------------------------------------------------------
    "pieces": """
        SELECT session_id, id AS turn_id, cwd, s AS turn_start, e IS NULL AS unfinished, quality,
               s, e FROM turns WHERE e > s
        UNION ALL
        SELECT t.session_id, t.id, t.cwd, t.s, TRUE, t.quality, c.s, c.e
        FROM turns t JOIN coverage c ON c.session_id = t.session_id AND c.turn_id = t.id
        WHERE t.e IS NULL AND c.e > c.s""",
    "readings": """
        SELECT session_id, turn_id, at_us,
               CASE WHEN count(DISTINCT model_id || '/' || reasoning_level) = 1
                    THEN any_value(model_id) END AS model_id,
               CASE WHEN count(DISTINCT model_id || '/' || reasoning_level) = 1
                    THEN any_value(reasoning_level) END AS reasoning_level,
               count(DISTINCT model_id || '/' || reasoning_level) > 1 AS conflict
        FROM contexts GROUP BY ALL""",
    "effective": """
        SELECT session_id, turn_id, f AS s, arg_max(model_id || '', at_us) AS dummy,
               (max(struct_pack(at_us := at_us, m := model_id, r := reasoning_level))).m AS model_id,
               (max(struct_pack(at_us := at_us, m := model_id, r := reasoning_level))).r
                   AS reasoning_level
        FROM (SELECT r.*, CASE WHEN r.at_us = min(r.at_us) OVER (PARTITION BY r.session_id, r.turn_id)
                               THEN t.s ELSE greatest(r.at_us, t.s) END AS f
              FROM readings r JOIN turns t ON t.session_id = r.session_id AND t.id = r.turn_id)
        GROUP BY ALL""",
    "timeline": """
        SELECT session_id, turn_id, s, lead(s) OVER (PARTITION BY session_id, turn_id
                                                     ORDER BY s) AS e, model_id, reasoning_level
        FROM (SELECT *, row_number() OVER w = 1
                     OR lag(model_id) OVER w IS DISTINCT FROM model_id
                     OR lag(reasoning_level) OVER w IS DISTINCT FROM reasoning_level AS change
              FROM effective WINDOW w AS (PARTITION BY session_id, turn_id ORDER BY s))
        WHERE change""",
    "points": """
        SELECT DISTINCT session_id, unnest([s, e]) AS p FROM pieces
        UNION SELECT DISTINCT session_id, unnest([s, e]) FROM waits
        UNION SELECT session_id, s FROM timeline""",
    "slots": """
        SELECT * FROM (SELECT session_id, p,
            lead(p) OVER (PARTITION BY session_id ORDER BY p) AS q FROM points)
        WHERE q IS NOT NULL""",
    "owned": """
        SELECT w.session_id, w.p, w.q,
               max(struct_pack(a := x.turn_start, b := x.turn_id, c := x.cwd,
                               d := x.unfinished)) AS owner,
               list_sort(list(x.turn_id)) AS turn_ids,
               list_sort(list_distinct(flatten(list(x.quality)))) AS quality
        FROM slots w JOIN pieces x ON x.session_id = w.session_id AND x.s <= w.p AND x.e >= w.q
        WHERE NOT EXISTS (SELECT 1 FROM waits v WHERE v.session_id = w.session_id
                          AND v.s <= w.p AND v.e >= w.q)
        GROUP BY w.session_id, w.p, w.q""",
    "facts": """
        SELECT o.session_id, o.p, o.q, o.owner.c AS cwd, o.owner.b AS owner_turn,
               o.turn_ids, t.model_id, t.reasoning_level, o.quality AS base_quality,
               list_sort(list_distinct(list_filter(list_concat(o.quality, [
                   CASE WHEN o.owner.d THEN 'unfinished' END,
                   CASE WHEN t.model_id IS NULL THEN 'unknown_model' END,
                   CASE WHEN t.reasoning_level IS NULL THEN 'unknown_reasoning' END]),
                   lambda x: x IS NOT NULL))) AS quality
        FROM owned o LEFT JOIN timeline t
          ON t.session_id = o.session_id AND t.turn_id = o.owner.b
         AND t.s <= o.p AND (t.e IS NULL OR t.e >= o.q)""",
    "daily": f"""
        SELECT * EXCLUDE (p, q, lo, hi), lo AS p, hi AS q, hi - lo AS micros FROM (
            SELECT f.*, greatest(p, {midnight_us('day')}) AS lo,
                   least(q, {midnight_us('day + 1')}) AS hi
            FROM (SELECT *, CAST(unnest(generate_series({us_day('p')}, {us_day('q - 1')},
                                 INTERVAL 1 DAY)) AS DATE) AS day FROM facts) f)
        WHERE hi > lo""",
    "counted": """
        SELECT *, total AS c1, total // 4 AS c2,
               CASE WHEN event_id % 5 <> 0 THEN total // 10 END AS c3, total // 2 AS c4,
               total // 8 AS c5, total + total // 2 AS c6
        FROM (SELECT *, CAST(sum(cents) OVER (PARTITION BY user_id, era ORDER BY us, event_id)
                             AS BIGINT) AS total
              FROM (SELECT *, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END)
                           OVER (PARTITION BY user_id ORDER BY us, event_id) AS era
                    FROM ev WHERE event_type IN ('view', 'click')))""",
    "stepped": """
        SELECT *, coalesce(c1 < p1 OR c2 < p2 OR c3 < p3 OR c4 < p4 OR c5 < p5 OR c6 < p6, FALSE)
                  AS falls
        FROM (SELECT *, row_number() OVER w = 1 AS first, lag(c1) OVER w AS p1,
                     lag(c2) OVER w AS p2, lag(c3) OVER w AS p3, lag(c4) OVER w AS p4,
                     lag(c5) OVER w AS p5, lag(c6) OVER w AS p6
              FROM counted WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))""",
    "usage": """
        SELECT event_id, session_id, turn_id, us AS at_us, '/' || event_type AS cwd,
               CASE WHEN event_id % 13 <> 0 THEN 'm' || (event_id % 4) END AS model_id, cents,
               CASE WHEN first THEN c1 WHEN NOT falls THEN c1 - p1 END AS d1,
               CASE WHEN first THEN c2 WHEN NOT falls THEN c2 - p2 END AS d2,
               CASE WHEN first THEN c3 WHEN NOT falls THEN c3 - p3 END AS d3,
               CASE WHEN first THEN c4 WHEN NOT falls THEN c4 - p4 END AS d4,
               CASE WHEN first THEN c5 WHEN NOT falls THEN c5 - p5 END AS d5,
               CASE WHEN first THEN c6 WHEN NOT falls THEN c6 - p6 END AS d6,
               list_filter([
                   CASE WHEN falls THEN 'counter_reset' END,
                   CASE WHEN NOT falls AND NOT first AND c1 = p1 AND c2 = p2 AND c4 = p4
                             AND c5 = p5 AND c6 = p6 AND coalesce(c3 - p3, 0) = 0
                        THEN 'repeated_cumulative_usage' END,
                   CASE WHEN NOT falls AND NOT first AND c3 IS NOT NULL AND p3 IS NULL
                        THEN 'category_baseline_unavailable' END],
                   lambda x: x IS NOT NULL) AS diagnostics,
               CASE WHEN event_id % 6 <> 0 THEN
                   CASE WHEN first THEN c1 WHEN NOT falls THEN c1 - p1 END END AS request
        FROM stepped""",
    "prices": """
        SELECT * FROM (VALUES
            ('m0', 'ordinary', NULL, 2.0, 0.5, NULL, 10.0, NULL, NULL, NULL, NULL),
            ('m1', 'separate', NULL, 2.5, 0.25, 3.125, 12.0, NULL, NULL, NULL, NULL),
            ('m2', 'separate', 2000, 4.0, 0.4, 5.0, 20.0, 8.0, 0.8, 10.0, 30.0))
        AS v(price_id, mode, threshold, si, sc, sw, so, li, lc, lw, lo)""",
    "priced": """
        SELECT *, greatest(known - billed, 0) AS unbilled FROM (
        SELECT *, n_cached + n_write + n_plain + n_out AS billed,
               n_cached * coalesce(rc, 0) + n_write * coalesce(rw, 0) + n_plain * ri + n_out * ro
                   AS cost
        FROM (
        SELECT *, CASE WHEN d1 = 0 AND coalesce(d2, 0) = 0 AND coalesce(d3, 0) = 0 THEN 0
                       WHEN coalesce(d2, 0) + coalesce(d3, 0) > d1 THEN 0 ELSE coalesce(d2, 0) END
                       AS n_cached,
               CASE WHEN coalesce(d2, 0) + coalesce(d3, 0) > d1 OR mode = 'ordinary' THEN 0
                    ELSE coalesce(d3, 0) END AS n_write,
               CASE WHEN coalesce(d2, 0) + coalesce(d3, 0) > d1 THEN 0
                    WHEN mode = 'ordinary' THEN d1 - d2
                    WHEN d3 IS NOT NULL THEN d1 - d2 - d3 ELSE 0 END AS n_plain,
               CASE WHEN coalesce(d5, 0) > d4 THEN 0 ELSE d4 END AS n_out,
               greatest(coalesce(d6, 0), d1 + d4) AS known,
               CASE WHEN d1 IS NULL THEN 'none'
                    WHEN greatest(d1, d2, d3, d4, d5, d6) = 0 THEN 'free'
                    WHEN price_id IS NULL THEN 'unlisted'
                    WHEN threshold IS NOT NULL AND request IS NULL THEN 'unsized'
                    WHEN d6 < d1 + d4 THEN 'clash' ELSE 'priced' END AS state
        FROM (SELECT u.*, p.*, coalesce(request > threshold, FALSE) AS is_long,
                     CASE WHEN request > threshold THEN li ELSE si END AS ri,
                     CASE WHEN request > threshold THEN lc ELSE sc END AS rc,
                     CASE WHEN request > threshold THEN lw ELSE sw END AS rw,
                     CASE WHEN request > threshold THEN lo ELSE so END AS ro
              FROM usage u LEFT JOIN prices p ON p.price_id = u.model_id)))""",
    "bills": """
        SELECT *, list_filter([
                CASE WHEN NOT (d1 = 0 AND coalesce(d2, 0) = 0 AND coalesce(d3, 0) = 0)
                      AND coalesce(d2, 0) + coalesce(d3, 0) > d1
                     THEN 'input subsets exceed observed input; input remains unpriced' END,
                CASE WHEN mode <> 'ordinary' AND d3 IS NULL AND d1 <> d2
                     THEN 'cache-write evidence unavailable; non-cached input unpriced' END,
                CASE WHEN coalesce(d5, 0) > d4
                     THEN 'reasoning subset exceeds output; output remains unpriced' END],
                lambda x: x IS NOT NULL) AS caveats
        FROM priced""",
    "billed_usage": """
        SELECT session_id, turn_id, at_us, cwd, model_id, diagnostics, d1, d2, d3, d4, d5, d6,
               CASE WHEN state = 'priced' THEN cost ELSE 0 END AS micro_usd,
               CASE WHEN state = 'priced' THEN billed ELSE 0 END AS priced_tokens,
               CASE state WHEN 'none' THEN 0 WHEN 'priced' THEN unbilled ELSE known END
                   AS unpriced_tokens,
               state = 'free' OR (state = 'priced' AND unbilled = 0 AND len(caveats) = 0)
                   AS complete,
               CASE WHEN state IN ('priced', 'clash') THEN
                   CASE WHEN is_long THEN 'long' ELSE 'short' END END AS tier,
               CASE state WHEN 'none' THEN ['usage increment unavailable']
                   WHEN 'free' THEN CAST([] AS VARCHAR[])
                   WHEN 'unlisted' THEN ['model has no verified Standard price']
                   WHEN 'unsized' THEN
                       ['request input size unavailable for long-context pricing']
                   WHEN 'clash' THEN ['total tokens conflict with input/output categories']
                   ELSE CASE WHEN len(caveats) = 0 AND unbilled > 0
                        THEN ['total includes tokens without a billing category']
                        ELSE caveats END END AS reasons
        FROM bills""",
    "walk": """
        SELECT id, id AS cur, [id] AS path FROM sessions
        UNION ALL
        SELECT w.id, s.parent_id, list_append(w.path, s.parent_id)
        FROM walk w JOIN sessions s ON s.id = w.cur
        WHERE s.parent_id IN (SELECT id FROM sessions) AND NOT list_contains(w.path, s.parent_id)""",
    "rooted": """
        SELECT e.id AS session_id,
               CASE WHEN s.parent_id IN (SELECT id FROM sessions) THEN list_min(e.path)
                    ELSE e.cur END AS root_id,
               CASE WHEN s.parent_id IS NULL THEN CAST([] AS VARCHAR[])
                    WHEN s.parent_id IN (SELECT id FROM sessions) THEN ['cyclic_child_ancestry']
                    ELSE ['orphaned_child'] END AS flags
        FROM (SELECT id, arg_max(cur, len(path)) AS cur, arg_max(path, len(path)) AS path
              FROM walk GROUP BY id) e JOIN sessions s ON s.id = e.cur""",
    "seen": f"""
        SELECT b.*, r.root_id, r.flags, o.archived AS root_archived
        FROM billed_usage b JOIN rooted r ON r.session_id = b.session_id
        JOIN sessions o ON o.id = r.root_id
        WHERE {us_day('at_us')} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "worked": """
        SELECT DISTINCT d.session_id, d.cwd, r.root_id, s.parent_id IS NOT NULL AS is_child,
               o.archived AS root_archived
        FROM daily d JOIN rooted r ON r.session_id = d.session_id
        JOIN sessions s ON s.id = d.session_id JOIN sessions o ON o.id = r.root_id
        WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "gaps": """
        SELECT w.*, NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = w.session_id
                                AND s.cwd = w.cwd) AS missing,
               EXISTS (SELECT 1 FROM seen s WHERE s.session_id = w.session_id
                       AND s.cwd = w.cwd AND s.model_id = 'm3') AS omitted
        FROM worked w""",
    "row_keys": """
        SELECT cwd, root_id FROM seen WHERE model_id IS DISTINCT FROM 'm3'
        UNION SELECT cwd, root_id FROM gaps WHERE NOT is_child AND (missing OR omitted)""",
    "token_cells": """
        SELECT cwd, root_id, session_id, model_id, d1, d2, d3, d4, d5, d6, 1 AS n,
               CASE WHEN d6 IS NULL THEN 1 ELSE 0 END AS unsure, priced_tokens, unpriced_tokens,
               micro_usd, complete, list_concat(list_concat(reasons, diagnostics), flags)
               AS reasons, FALSE AS missing, FALSE AS omitted, TRUE AS attached
        FROM seen WHERE model_id IS DISTINCT FROM 'm3'
        UNION ALL
        SELECT g.cwd, g.root_id, g.session_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0,
               0, 0, TRUE, CAST([] AS VARCHAR[]), missing, omitted,
               NOT is_child OR (g.cwd, g.root_id) IN (SELECT (cwd, root_id) FROM row_keys)
        FROM gaps g WHERE missing OR omitted
        UNION ALL
        SELECT cwd, root_id, session_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 0, 0,
               TRUE, CAST([] AS VARCHAR[]), FALSE, TRUE, FALSE
        FROM seen WHERE model_id = 'm3'""",
    "rollup_rows": """
        SELECT * FROM (
        SELECT CASE WHEN l = 1 THEN 'total' WHEN l = 2 THEN 'model' WHEN l = 3 THEN 'directory'
                    WHEN l = 4 THEN 'directory_model' WHEN l = 5 THEN 'session'
                    WHEN l = 6 THEN 'session_model' ELSE 'child' END AS level,
               CASE WHEN l > 2 THEN cwd END AS cwd, CASE WHEN l > 4 THEN root_id END AS root_id,
               CASE WHEN l = 7 THEN session_id END AS child_id,
               CASE WHEN l IN (2, 4, 6, 7) THEN model_id END AS model_id,
               CAST(sum(d1) AS BIGINT) AS input_tokens,
               CAST(sum(d2) AS BIGINT) AS cached_input_tokens,
               CAST(sum(d3) AS BIGINT) AS cache_write_input_tokens,
               CAST(sum(d4) AS BIGINT) AS output_tokens,
               CAST(sum(d5) AS BIGINT) AS reasoning_output_tokens,
               CAST(sum(d6) AS BIGINT) AS total_tokens,
               CAST(sum(n) AS BIGINT) AS observations,
               CAST(sum(unsure) AS BIGINT) AS uncertain_observations,
               count(DISTINCT CASE WHEN missing THEN session_id END) AS unavailable_sessions,
               CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens,
               CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens,
               sum(micro_usd) AS micro_usd, bool_and(complete) AS complete,
               bool_or(omitted) AS omitted,
               list_sort(list_distinct(flatten(list(reasons)))) AS reasons
        FROM token_cells, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS l)
        WHERE l = 1 OR (attached AND (l <> 7 OR session_id <> root_id))
        GROUP BY ALL)
        WHERE NOT (level IN ('model', 'directory_model', 'session_model') AND observations = 0)
          AND NOT (level = 'child' AND observations = 0 AND unavailable_sessions = 0)""",
    "rollup": """
        SELECT level, cwd, root_id, child_id, model_id,
               CASE WHEN observations = 0 THEN
                        CASE WHEN omitted AND unavailable_sessions = 0 THEN 'excluded'
                             ELSE 'unavailable' END
                    WHEN uncertain_observations > 0 OR unavailable_sessions > 0 THEN 'partial'
                    ELSE 'recorded' END AS status,
               input_tokens, cached_input_tokens, cache_write_input_tokens, output_tokens,
               reasoning_output_tokens, total_tokens, observations, uncertain_observations,
               unavailable_sessions, priced_tokens, unpriced_tokens,
               observations > 0 AND unavailable_sessions = 0 AND uncertain_observations = 0
                   AND complete AS cost_complete,
               round(CAST(micro_usd AS DOUBLE), 6) AS micro_usd,
               CAST(round(micro_usd * 1000) AS BIGINT) AS usd_e9,
               CAST(round(micro_usd * 135000) AS BIGINT) AS cad_e11,
               array_to_string(CASE WHEN unavailable_sessions > 0 THEN list_sort(list_append(
                   reasons, 'usage_unavailable_for_recorded_work')) ELSE reasons END, ',')
                   AS diagnostics
        FROM rollup_rows""",
    "cohort_of": """
        SELECT resets_at, first_value(resets_at) OVER (
                   PARTITION BY (resets_at - 1704067200) // 604800 ORDER BY first_at, resets_at)
                   AS cohort
        FROM (SELECT resets_at, min(at_us) AS first_at FROM quota GROUP BY resets_at)""",
    "moments": """
        SELECT at_us, min(cohort) AS cohort,
               min(cohort) <> max(cohort) OR min(used) <> max(used) AS conflict,
               min(used) AS used, min(q.resets_at) AS resets_at
        FROM quota q JOIN cohort_of c ON c.resets_at = q.resets_at GROUP BY at_us""",
    "cohort_seen": """
        SELECT cohort, min(at_us) AS seen_at FROM moments WHERE NOT conflict GROUP BY cohort""",
    "verdicts": """
        SELECT m.*, CASE WHEN conflict THEN 'conflict'
                    WHEN EXISTS (SELECT 1 FROM cohort_seen a JOIN cohort_seen b
                                 ON b.seen_at > a.seen_at AND b.seen_at <= m.at_us
                                 WHERE a.cohort = m.cohort) THEN 'retired' END AS early,
               sum(CASE WHEN conflict THEN 1 ELSE 0 END) OVER (ORDER BY at_us) AS conflicts
        FROM moments m""",
    "judged": """
        SELECT at_us, cohort, used, resets_at, conflicts, coalesce(early,
               CASE WHEN used < max(used) OVER (PARTITION BY cohort, early ORDER BY at_us
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                    THEN 'stale' ELSE 'accepted' END) AS verdict
        FROM verdicts""",
    "adjacent": """
        SELECT at_us, cohort, used, resets_at,
               CASE WHEN pc = conflicts THEN pa END AS from_us,
               CASE WHEN pc = conflicts THEN used - pu END AS points
        FROM (SELECT *, lag(at_us) OVER w AS pa, lag(used) OVER w AS pu, lag(conflicts) OVER w AS pc
              FROM judged WHERE verdict = 'accepted'
              WINDOW w AS (PARTITION BY cohort ORDER BY at_us))""",
    "classed": f"""
        SELECT *, {us_day('at_us')} AS day,
               CASE WHEN from_us IS NULL THEN NULL
                    WHEN from_us < {midnight_us("DATE '2024-01-08'")}
                      OR {us_day('from_us')} <> {us_day('at_us')} THEN 'boundary'
                    WHEN at_us - from_us > 1800000000 THEN 'gap' ELSE 'candidate' END AS kind
        FROM adjacent WHERE {us_day('at_us')} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "met": """
        SELECT c.day, c.cohort, c.at_us, f.model_id, f.reasoning_level, f.session_id, f.turn_ids,
               list_concat(f.quality, f.session_quality) AS quality,
               least(c.at_us, f.q) - greatest(c.from_us, f.p) AS micros
        FROM classed c JOIN root_daily f ON f.p < c.at_us AND f.q > c.from_us
        WHERE c.kind = 'candidate'""",
    "settled": """
        SELECT c.*, coalesce(w.micros, 0) AS micros,
               CASE WHEN c.kind = 'candidate' THEN
                   CASE WHEN w.micros > 0 THEN 'matched' ELSE 'no_work' END ELSE c.kind END AS final
        FROM classed c LEFT JOIN (SELECT at_us, cohort, sum(micros) AS micros FROM met
                                  GROUP BY ALL) w
          ON w.at_us = c.at_us AND w.cohort = c.cohort""",
    "burn_keys": f"""
        SELECT day, cohort FROM settled
        UNION SELECT {us_day('at_us')}, cohort FROM judged WHERE verdict IN ('stale', 'retired')
          AND {us_day('at_us')} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
        UNION SELECT {us_day('j.at_us')}, c.cohort FROM judged j, (
            SELECT DISTINCT cohort FROM cohort_of o JOIN quota q ON q.resets_at = o.resets_at
            WHERE q.at_us < {midnight_us("DATE '2024-01-15'")}) c
        WHERE j.verdict = 'conflict'
          AND {us_day('j.at_us')} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "burn": f"""
        SELECT k.day, k.cohort,
               coalesce(sum(points) FILTER (final = 'matched'), 0) AS matched_points,
               CAST(coalesce(sum(micros) FILTER (final = 'matched'), 0) AS BIGINT) AS micros,
               count(*) FILTER (final = 'matched') AS matched_windows,
               count(*) FILTER (final = 'matched' AND NOT EXISTS (
                   SELECT 1 FROM settled o WHERE o.cohort = s.cohort AND o.final = 'matched'
                     AND o.at_us = s.from_us)) AS blocks,
               coalesce(sum(points) FILTER (final = 'gap'), 0) AS gap_points,
               coalesce(sum(points) FILTER (final = 'no_work'), 0) AS no_work_points,
               coalesce(sum(points) FILTER (final = 'boundary'), 0) AS boundary_points,
               list_distinct(list(final)) AS finals
        FROM burn_keys k LEFT JOIN settled s ON s.day = k.day AND s.cohort = k.cohort
        GROUP BY ALL""",
    "burn_full": f"""
        SELECT b.*, (SELECT count(*) FROM judged j WHERE j.cohort = b.cohort
                       AND verdict IN ('stale', 'retired') AND {us_day('j.at_us')} = b.day)
                   AS stale_readings,
               list_sort(list_distinct(list_filter(list_concat(
                   coalesce((SELECT flatten(list(quality)) FROM met m WHERE m.day = b.day
                             AND m.cohort = b.cohort), CAST([] AS VARCHAR[])),
                   ['low_confidence', 'account_wide_allowance',
                    CASE WHEN list_contains(finals, 'boundary')
                         THEN 'calendar_boundary_excluded' END,
                    CASE WHEN list_contains(finals, 'gap') THEN 'quota_observation_gap' END,
                    CASE WHEN list_contains(finals, 'no_work')
                         THEN 'quota_without_root_work' END,
                    CASE WHEN EXISTS (SELECT 1 FROM judged j WHERE j.cohort = b.cohort
                              AND verdict = 'retired' AND {us_day('j.at_us')} = b.day)
                         THEN 'retired_reset_reading' END,
                    CASE WHEN EXISTS (SELECT 1 FROM judged j WHERE verdict = 'conflict'
                              AND {us_day('j.at_us')} = b.day)
                         THEN 'conflicting_quota_observation' END]),
                   lambda x: x IS NOT NULL))) AS quality,
               coalesce((SELECT sum(uncertainty) FROM (
                   SELECT DISTINCT t.session_id, t.id, t.uncertainty
                   FROM (SELECT session_id, unnest(turn_ids) AS tid FROM met m
                         WHERE m.day = b.day AND m.cohort = b.cohort) x
                   JOIN turns t ON t.session_id = x.session_id AND t.id = x.tid)), 0) AS uncertainty
        FROM burn b""",
    # For each event of the log: the turn that is open when its lines begin.
    "log_state": """
        SELECT *, CASE WHEN carried % 17 = 0 AND shut IS NULL THEN carried END AS open_event
        FROM (SELECT e.*, (SELECT max(struct_pack(us := o.us, id := o.event_id)).id FROM ev o
                      WHERE o.user_id = e.user_id AND o.event_id % 23 <> 0
                        AND (o.us, o.event_id) < (e.us, e.event_id)) AS carried
              FROM ev e) x
        LEFT JOIN LATERAL (SELECT min(c.event_id) AS shut FROM ev c, ev o
            WHERE o.event_id = x.carried AND c.user_id = x.user_id AND c.event_id % 23 = 0
              AND c.event_id % 17 <> 0 AND c.event_id % 5 = 0
              AND (c.us, c.event_id) > (o.us, o.event_id)
              AND (c.us, c.event_id) < (x.us, x.event_id)) ON TRUE""",
    "log_turn": """
        SELECT *, CASE WHEN event_id % 23 <> 0 THEN event_id ELSE open_event END AS now_event
        FROM log_state""",
    "polls": """
        SELECT session_id, us // 43200000000 AS poll_id, min(us) - 60000000 AS at_us,
               arg_min(CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE
                   ['working', 'waiting', 'idle', 'working'][event_id % 4 + 1] END, us) AS state
        FROM ev GROUP BY 1, 2""",
    "poll_pairs": """
        SELECT *, CASE WHEN state = 'unknown' THEN 'gap' WHEN before_at IS NULL THEN 'none'
                       WHEN poll_id <> before_poll + 1 THEN 'gap'
                       WHEN at_us - before_at > 86400000000 THEN 'gap'
                       WHEN before_state = 'working' THEN 'work'
                       WHEN before_state = 'waiting' THEN 'wait' ELSE 'none' END AS kind
        FROM (SELECT *, lag(poll_id) OVER w AS before_poll, lag(at_us) OVER w AS before_at,
                     lag(state) OVER w AS before_state
              FROM polls WINDOW w AS (PARTITION BY session_id ORDER BY poll_id))""",
    "gap_samples": """
        SELECT *, coalesce(before_poll <> poll_id - 1, true) AS fresh,
               coalesce(lead(poll_id) OVER (PARTITION BY session_id ORDER BY poll_id) <> poll_id + 1, true) AS last
        FROM poll_pairs""",
    "poll_times": """
        SELECT poll_id, lead(max(at_us)) OVER (ORDER BY poll_id) AS gone FROM polls GROUP BY poll_id""",
    "live_spans": """
        SELECT session_id, turn_id, start_us FROM (
        SELECT p.session_id, t.id AS turn_id, greatest(p.before_at, t.s) AS start_us,
               least(p.at_us, coalesce(t.e, p.at_us)) AS end_us
        FROM poll_pairs p JOIN turns t ON t.session_id = p.session_id AND t.s <= p.at_us
          AND (t.e IS NULL OR t.e >= p.before_at)
        WHERE p.kind IN ('work', 'wait')
        QUALIFY row_number() OVER (PARTITION BY p.session_id, p.at_us
                                   ORDER BY t.s DESC, t.id DESC) = 1)
        WHERE end_us > start_us""",
    "observed_from": """
        SELECT session_id, turn_id, min(start_us) AS observed FROM (
            SELECT session_id, turn_id, start_us FROM live_spans
            UNION ALL SELECT session_id, turn_id, s FROM coverage
            UNION ALL SELECT session_id, turn_id, s FROM waits) GROUP BY 1, 2""",
    "gap_events": """
        SELECT session_id, at_us, CASE WHEN state = 'unknown' THEN 'unknown' ELSE 'spacing' END AS reason
        FROM gap_samples
        WHERE state = 'unknown' OR (NOT fresh AND at_us - before_at > 86400000000)
        UNION ALL SELECT s.session_id, p.gone, 'vanished' FROM gap_samples s JOIN poll_times p USING (poll_id)
        WHERE s.last AND p.gone IS NOT NULL
        UNION ALL SELECT a.session_id, a.at_us, 'restarted' FROM (
            SELECT s.session_id, s.at_us, t.id FROM gap_samples s JOIN turns t ON t.session_id = s.session_id
              AND t.s <= s.at_us AND (t.e IS NULL OR t.e >= s.at_us)
            WHERE s.fresh AND s.state <> 'unknown'
            QUALIFY row_number() OVER (PARTITION BY s.session_id, s.at_us ORDER BY t.s DESC, t.id DESC) = 1) a
        JOIN observed_from o ON o.session_id = a.session_id AND o.turn_id = a.id AND o.observed < a.at_us""",
    "log_tokens": """
        SELECT t.*, EXISTS (SELECT 1 FROM ev g WHERE g.user_id = t.user_id AND g.event_id % 101 = 0
                            AND (g.us, g.event_id) <= (t.us, t.event_id)
                            AND (t.prev IS NULL OR (g.us, g.event_id) > (t.prev.u, t.prev.i))) AS gap
        FROM (SELECT *, lag(struct_pack(u := us, i := event_id)) OVER (
                     PARTITION BY user_id ORDER BY us, event_id) AS prev FROM stepped) t""",
    "log_seen": """
        SELECT t.*, max(CASE WHEN gap THEN struct_pack(u := us, i := event_id) END) OVER (
                   PARTITION BY user_id ORDER BY us, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blind,
               (SELECT max(struct_pack(u := c.us, i := c.event_id,
                                       m := CASE WHEN c.event_id % 29 <> 0
                                                 THEN 'm' || (c.event_id % 4) END,
                                       d := '/' || c.event_type))
                FROM ev c WHERE c.user_id = t.user_id AND c.event_id % 13 <> 0
                  AND (c.us, c.event_id) <= (t.us, t.event_id)) AS ctx,
               (SELECT max(struct_pack(u := o.us, i := o.event_id,
                        t := CASE WHEN o.event_id % 13 = 0 OR o.event_id % 7 <> 0 THEN o.event_id
                                  ELSE o.now_event END))
                FROM log_turn o WHERE o.user_id = t.user_id
                  AND (o.event_id % 13 <> 0 OR o.event_id % 23 <> 0)
                  AND (o.us, o.event_id) <= (t.us, t.event_id)) AS turn
        FROM log_tokens t""",
    "log_models": """
        SELECT *, ctx.u IS NOT NULL AND (blind.u IS NULL OR (ctx.u, ctx.i) > (blind.u, blind.i))
                  AS informed,
               coalesce(ctx.d, '/home') AS raw_cwd,
               CASE WHEN NOT gap AND (blind.u IS NULL OR (ctx.u, ctx.i) > (blind.u, blind.i))
                    THEN ctx.m END AS held_model
        FROM log_seen""",
    "log_changes": """
        SELECT t.*, (SELECT count(DISTINCT coalesce(v, '-')) > 1 FROM (
                   SELECT p.held_model AS v FROM log_models p WHERE p.user_id = t.user_id
                     AND p.event_id = t.prev.i
                   UNION ALL SELECT CASE WHEN c.event_id % 29 <> 0 THEN 'm' || (c.event_id % 4) END
                   FROM ev c WHERE c.user_id = t.user_id AND c.event_id % 13 <> 0
                     AND (c.us, c.event_id) <= (t.us, t.event_id)
                     AND (t.prev IS NULL OR (c.us, c.event_id) > (t.prev.u, t.prev.i))))
                   AS model_changed,
               (SELECT count(DISTINCT v) > 1 FROM (
                   SELECT coalesce((SELECT p.raw_cwd FROM log_models p WHERE p.user_id = t.user_id
                     AND p.event_id = t.prev.i), '/home') AS v
                   UNION ALL SELECT '/' || c.event_type
                   FROM ev c WHERE c.user_id = t.user_id AND c.event_id % 13 <> 0
                     AND (c.us, c.event_id) <= (t.us, t.event_id)
                     AND (t.prev IS NULL OR (c.us, c.event_id) > (t.prev.u, t.prev.i))))
                   AS cwd_changed,
               CASE WHEN first AND user_id % 5 = 0 AND user_id > 0 AND cents + cents // 2 = 0
                         THEN 'child_baseline_unavailable'
                    WHEN first AND user_id % 6 = 1 THEN 'fork_baseline_unavailable'
                    WHEN first AND gap THEN 'baseline_unavailable'
                    WHEN falls THEN 'counter_reset' END AS lost
        FROM log_models t""",
    "log_usage": """
        SELECT *, CASE WHEN lost IS NULL THEN CASE WHEN first THEN c1 ELSE c1 - p1 END END AS d1,
               CASE WHEN lost IS NULL THEN CASE WHEN first THEN c6 ELSE c6 - p6 END END AS d6,
               CASE WHEN lost IS NULL AND (CASE WHEN first THEN c1 ELSE c1 - p1 END) = cents
                     AND (CASE WHEN first THEN c2 ELSE c2 - p2 END) = cents // 4
                     AND (CASE WHEN first THEN c3 ELSE c3 - p3 END) IS NOT DISTINCT FROM
                         CASE WHEN event_id % 5 <> 0 THEN cents // 10 END
                     AND (CASE WHEN first THEN c4 ELSE c4 - p4 END) = cents // 2
                     AND (CASE WHEN first THEN c5 ELSE c5 - p5 END) = cents // 8
                     AND (CASE WHEN first THEN c6 ELSE c6 - p6 END) = cents + cents // 2
                     AND cents + cents // 2 <> 0 THEN cents END AS request,
               lost IS NULL AND NOT first AND c1 = p1 AND c2 = p2 AND c4 = p4 AND c5 = p5
                   AND c6 = p6 AND coalesce(c3 - p3, 0) = 0 AS still
        FROM log_changes""",
    "roots": "SELECT * FROM sessions WHERE parent_id IS NULL",
    "root_daily": """
        SELECT d.*, r.quality AS session_quality
        FROM daily d JOIN roots r ON r.id = d.session_id""",
}


def _needed(body: str) -> list[str]:
    """Views the body uses, each after the views it uses itself."""
    order: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for word in re.findall(r"[A-Za-z_]+", text):
            if word in VIEWS and word != inside and word not in order:
                visit(VIEWS[word], word)
                order.append(word)

    visit(body)
    return order


def statement(body: str) -> str:
    """A complete statement: the views the body uses, then the body."""
    parts = [
        f"{name} AS {'' if name == 'walk' else 'MATERIALIZED '}({VIEWS[name]})"
        for name in _needed(body)
    ]
    inner = body.strip()
    if inner.upper().startswith("WITH "):
        inner = inner[5:]
        return "WITH RECURSIVE " + ",\n".join([*parts, inner])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + inner if parts else inner


STATEMENTS: dict[str, str] = {
    "merge_spans": """
        WITH spans AS (SELECT session_id, s, e FROM turns WHERE e > s),
        marked AS (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM spans),
        runs AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END)
                        OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run
                 FROM marked)
        SELECT session_id, min(s) AS start_us, max(e) AS end_us FROM runs GROUP BY session_id, run""",
    "subtract_spans": """
        WITH runs AS (SELECT *, sum(CASE WHEN seen = p THEN 0 ELSE 1 END) OVER (
                     PARTITION BY session_id ORDER BY p) AS run
              FROM (SELECT session_id, p, q, lag(q) OVER (PARTITION BY session_id ORDER BY p) AS seen
                    FROM owned))
        SELECT session_id, min(p) AS start_us, max(q) AS end_us FROM runs GROUP BY session_id, run""",
    "work_segments": """
        WITH marked AS (SELECT session_id, p, q, owner.c AS cwd, owner.b AS owner_turn,
                array_to_string(turn_ids, ',') AS turn_ids, array_to_string(quality, ',') AS quality
            FROM owned),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY p) AS run FROM (
            SELECT *, CASE WHEN lag(q) OVER w = p AND lag(cwd) OVER w = cwd
                            AND lag(turn_ids) OVER w = turn_ids AND lag(quality) OVER w = quality
                           THEN 0 ELSE 1 END AS fresh
            FROM marked WINDOW w AS (PARTITION BY session_id ORDER BY p)))
        SELECT session_id, min(p) AS start_us, max(q) AS end_us, any_value(cwd) AS cwd,
               any_value(owner_turn) AS owner_turn, any_value(turn_ids) AS turn_ids,
               any_value(quality) AS quality
        FROM runs GROUP BY session_id, run""",
    "split_by_local_day": f"""
        SELECT session_id, id AS turn_id, CAST(day AS VARCHAR) AS day, hi - lo AS micros FROM (
            SELECT session_id, id, day, greatest(s, {midnight_us('day')}) AS lo,
                   least(e, {midnight_us('day + 1')}) AS hi
            FROM (SELECT *, CAST(unnest(generate_series({us_day('s')}, {us_day('e - 1')},
                                 INTERVAL 1 DAY)) AS DATE) AS day FROM turns WHERE e > s))
        WHERE hi > lo""",
    "overlap_join": """
        SELECT t.session_id, t.id AS turn_id,
               CAST(sum(least(t.e, w.e) - greatest(t.s, w.s)) AS BIGINT) AS micros
        FROM turns t JOIN waits w ON w.session_id = t.session_id AND t.s < w.e AND w.s < t.e
        WHERE t.e > t.s GROUP BY 1, 2""",
    "overlap_measure": """
        SELECT t.session_id, t.id AS turn_id, o.cwd,
               CAST(sum(least(t.e, o.e) - greatest(t.s, o.s)) AS BIGINT) AS micros
        FROM turns t JOIN turns o ON o.session_id = t.session_id AND t.s < o.e AND o.s < t.e
        WHERE t.e > t.s AND o.e > o.s GROUP BY 1, 2, 3""",
    "elapsed_micros": "SELECT session_id, id AS turn_id, e - s AS micros FROM turns WHERE e >= s",
    "prune_to_period": f"""
        SELECT id FROM sessions WHERE id IN (
            SELECT session_id FROM pieces
            WHERE s < {midnight_us("DATE '2024-01-11'")} AND e > {midnight_us("DATE '2024-01-10'")})""",
    "context_timeline": """
        SELECT session_id, turn_id, s AS start_us, e AS end_us, model_id, reasoning_level
        FROM timeline""",
    "context_conflicts": "SELECT session_id, turn_id, at_us FROM readings WHERE conflict",
    "latest_model": """
        WITH newest AS (SELECT session_id, model_id, reasoning_level FROM contexts c
            WHERE at_us = (SELECT max(at_us) FROM contexts d WHERE d.session_id = c.session_id)),
        held AS (SELECT session_id, count(DISTINCT model_id || '/' || reasoning_level) AS n,
                 any_value(model_id) AS m, any_value(reasoning_level) AS r
                 FROM newest GROUP BY session_id)
        SELECT session_id, CASE WHEN n = 1 THEN m END AS model_id,
               CASE WHEN n = 1 THEN r END AS reasoning_level FROM held""",
    "attributed_segments": """
        WITH marked AS (SELECT f.session_id, p, q, f.cwd, owner_turn,
                array_to_string(turn_ids, ',') AS turn_ids, model_id, reasoning_level,
                array_to_string(list_sort(list_distinct(list_concat(f.quality, r.quality))), ',')
                    AS quality
            FROM facts f JOIN roots r ON r.id = f.session_id),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY p) AS run FROM (
            SELECT *, CASE WHEN lag(q) OVER w = p AND lag(cwd) OVER w = cwd
                            AND lag(turn_ids) OVER w = turn_ids AND lag(quality) OVER w = quality
                            AND lag(model_id) OVER w IS NOT DISTINCT FROM model_id
                            AND lag(reasoning_level) OVER w IS NOT DISTINCT FROM reasoning_level
                           THEN 0 ELSE 1 END AS fresh
            FROM marked WINDOW w AS (PARTITION BY session_id ORDER BY p)))
        SELECT session_id, min(p) AS start_us, max(q) AS end_us, any_value(cwd) AS cwd,
               any_value(owner_turn) AS owner_turn, any_value(turn_ids) AS turn_ids,
               any_value(model_id) AS model_id, any_value(reasoning_level) AS reasoning_level,
               any_value(quality) AS quality
        FROM runs GROUP BY session_id, run""",
    "history_report": """
        WITH cells AS (SELECT CAST(day AS VARCHAR) AS day, cwd, session_id, micros FROM root_daily
            UNION ALL SELECT NULL, NULL, id, 0 FROM roots)
        SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(cwd) = 0 THEN 'directory'
                    WHEN grouping(session_id) = 0 THEN 'session' ELSE 'total' END AS level,
               day, cwd, session_id, CAST(sum(micros) AS BIGINT) AS micros
        FROM cells GROUP BY GROUPING SETS ((day), (cwd), (session_id), ())
        HAVING NOT (grouping(day) = 0 AND day IS NULL)
           AND NOT (grouping(cwd) = 0 AND cwd IS NULL)""",
    "history_active_week": """
        WITH cells AS (SELECT CAST(day AS VARCHAR) AS day, d.cwd, session_id, micros
            FROM root_daily d JOIN sessions s ON s.id = d.session_id AND NOT s.archived
            WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND d.cwd = '/view'
            UNION ALL SELECT NULL, NULL, id, 0 FROM roots r
            WHERE NOT archived AND (cwd = '/view' OR id IN (
                SELECT session_id FROM turns WHERE cwd = '/view')))
        SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(cwd) = 0 THEN 'directory'
                    WHEN grouping(session_id) = 0 THEN 'session' ELSE 'total' END AS level,
               day, cwd, session_id, CAST(sum(micros) AS BIGINT) AS micros
        FROM cells GROUP BY GROUPING SETS ((day), (cwd), (session_id), ())
        HAVING NOT (grouping(day) = 0 AND day IS NULL)
           AND NOT (grouping(cwd) = 0 AND cwd IS NULL)""",
    "history_quality": """
        SELECT array_to_string(list_sort(list_distinct(flatten(list(quality)))), ',') AS quality
        FROM (SELECT quality FROM roots UNION ALL
              SELECT t.quality FROM turns t JOIN roots r ON r.id = t.session_id)""",
}


def _model_time(where: str, level: str) -> str:
    return f"""
        WITH rows AS (SELECT session_id, turn_ids, model_id, {level} AS reasoning_level, micros,
                             list_concat(quality, session_quality) AS quality
                      FROM root_daily WHERE {where}),
        unsure AS (SELECT model_id, reasoning_level, sum(uncertainty) AS uncertainty FROM (
            SELECT DISTINCT r.model_id, r.reasoning_level, r.session_id, t.id, t.uncertainty
            FROM (SELECT session_id, model_id, reasoning_level, unnest(turn_ids) AS tid
                  FROM rows) r
            JOIN turns t ON t.session_id = r.session_id AND t.id = r.tid) GROUP BY ALL),
        grouped AS (SELECT model_id, reasoning_level, CAST(sum(micros) AS BIGINT) AS micros,
                count(DISTINCT session_id) AS session_count,
                array_to_string(list_sort(list_distinct(flatten(list(quality)))), ',') AS quality
            FROM rows GROUP BY model_id, reasoning_level)
        SELECT CASE WHEN g.model_id IS NOT NULL THEN row_number() OVER (
                    ORDER BY g.model_id IS NULL, micros DESC, g.model_id,
                             coalesce(g.reasoning_level, '')) END AS rank,
               g.model_id, g.reasoning_level, micros,
               round(micros * 100.0 / sum(micros) OVER (), 6) AS percentage, session_count, quality,
               CAST(coalesce(u.uncertainty, 0) AS DOUBLE) AS uncertainty
        FROM grouped g LEFT JOIN unsure u ON u.model_id IS NOT DISTINCT FROM g.model_id
          AND u.reasoning_level IS NOT DISTINCT FROM g.reasoning_level"""


STATEMENTS["model_time_report"] = _model_time(
    "day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", "reasoning_level")
STATEMENTS["model_only_rollup"] = _model_time(
    "day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", "CAST(NULL AS VARCHAR)")
STATEMENTS["distinct_uncertainty_sum"] = """
        SELECT CAST(sum(uncertainty) AS DOUBLE) AS uncertainty FROM turns t WHERE EXISTS (
            SELECT 1 FROM root_daily d WHERE d.session_id = t.session_id
              AND list_contains(d.turn_ids, t.id)
              AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14')"""


STATEMENTS.update({
    "counter_delta": """
        SELECT event_id, d1 AS input_tokens, d2 AS cached_input_tokens,
               d3 AS cache_write_input_tokens, d4 AS output_tokens,
               d5 AS reasoning_output_tokens, d6 AS total_tokens,
               array_to_string(diagnostics, ',') AS diagnostics FROM usage""",
    "request_input_proof": """
        SELECT event_id, CASE WHEN d6 <> 0 AND d1 = cents AND d4 = cents // 2
            AND d6 = cents + cents // 2 AND d2 = cents // 4 AND d5 = cents // 8
            AND d3 IS NOT DISTINCT FROM CASE WHEN event_id % 5 <> 0 THEN cents // 10 END
            THEN d1 END AS request FROM usage""",
    "usage_identity": """
        SELECT count(*) AS ids, 2 * count(*) AS readings, 64 AS digits FROM usage""",
    "dedupe_usage": "SELECT session_id, count(*) AS observations FROM usage GROUP BY session_id",
    "root_session": """
        SELECT session_id, root_id, array_to_string(flags, ',') AS flags FROM rooted""",
    "price_usage": """
        SELECT session_id, turn_id, round(CAST(micro_usd AS DOUBLE), 6) AS micro_usd,
               priced_tokens, unpriced_tokens, complete, tier,
               array_to_string(reasons, ',') AS reasons FROM billed_usage""",
    "coverage_gaps": """
        SELECT session_id, cwd, root_id, attached FROM token_cells WHERE missing""",
    "token_rollup": "SELECT * FROM rollup",
    "token_report_filtered": """
        WITH mine AS (SELECT * FROM seen WHERE cwd = '/view' AND NOT root_archived),
        lacking AS (SELECT * FROM worked w WHERE cwd = '/view' AND NOT root_archived
            AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.session_id = w.session_id)),
        parts AS (SELECT root_id, d6, priced_tokens, complete, 1 AS n,
                    CASE WHEN d6 IS NULL THEN 1 ELSE 0 END AS unsure, 0 AS gap FROM mine
            UNION ALL SELECT root_id, NULL, 0, TRUE, 0, 0, 1 FROM lacking
            WHERE NOT is_child OR root_id IN (SELECT root_id FROM mine UNION
                SELECT root_id FROM lacking WHERE NOT is_child))
        SELECT root_id, CASE WHEN sum(n) = 0 THEN 'unavailable'
                    WHEN sum(unsure) > 0 OR sum(gap) > 0 THEN 'partial' ELSE 'recorded' END AS status,
               CAST(sum(d6) AS BIGINT) AS total_tokens,
               CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens,
               CAST(sum(gap) AS BIGINT) AS unavailable_sessions,
               sum(n) > 0 AND sum(gap) = 0 AND sum(unsure) = 0 AND bool_and(complete)
                   AS cost_complete
        FROM parts GROUP BY root_id""",
    "projects_report": """
        WITH work AS (SELECT cwd, session_id AS root_id, CAST(sum(micros) AS BIGINT) AS micros,
                list_distinct(flatten(list(base_quality))) AS quality
            FROM root_daily WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
            GROUP BY 1, 2),
        tokens AS (SELECT * FROM rollup WHERE level = 'session'),
        rows AS (SELECT coalesce(w.cwd, t.cwd) AS cwd, coalesce(w.root_id, t.root_id) AS root_id,
                coalesce(micros, 0) AS micros, coalesce(w.quality, CAST([] AS VARCHAR[])) AS q,
                t.status, t.total_tokens, t.micro_usd, t.cost_complete
            FROM work w FULL JOIN tokens t ON t.cwd = w.cwd AND t.root_id = w.root_id),
        named AS (SELECT r.*, s.title, list_sort(list_distinct(list_concat(q, s.quality))) AS quality
            FROM rows r JOIN sessions s ON s.id = r.root_id),
        dirs AS (SELECT cwd, CAST(sum(micros) AS BIGINT) AS micros,
                list_sort(list_distinct(flatten(list(quality)))) AS quality FROM named GROUP BY cwd)
        SELECT 'session' AS level, cwd, root_id, title, micros,
               round(micros * 100.0 / (SELECT sum(micros) FROM named), 6) AS share_percent,
               array_to_string(quality, ',') AS quality, status, total_tokens, micro_usd,
               cost_complete FROM named
        UNION ALL
        SELECT 'directory', d.cwd, NULL, '', d.micros,
               round(d.micros * 100.0 / (SELECT sum(micros) FROM named), 6),
               array_to_string(d.quality, ','), r.status, r.total_tokens, r.micro_usd,
               r.cost_complete
        FROM dirs d JOIN rollup r ON r.level = 'directory' AND r.cwd = d.cwd""",
})


STATEMENTS.update({
    "quota_select": """
        SELECT at_us, resets_at, CAST(used AS DOUBLE) AS used_percent FROM quota""",
    "reset_cohorts": "SELECT resets_at, cohort FROM cohort_of",
    "quota_verdicts": """
        SELECT j.at_us, j.cohort, CAST(j.used AS DOUBLE) AS used_percent, verdict,
               a.from_us AS previous_us
        FROM judged j LEFT JOIN adjacent a ON a.at_us = j.at_us AND a.cohort = j.cohort
          AND j.verdict = 'accepted'""",
    "classify_pairs": """
        SELECT at_us, cohort, CAST(day AS VARCHAR) AS day, kind, CAST(points AS DOUBLE) AS points
        FROM classed""",
    "burn_rows": """
        SELECT CAST(day AS VARCHAR) AS day, 'primary' AS bucket,
               cohort AS resets_at, CAST(matched_points AS DOUBLE) AS matched_points, micros,
               round(micros / 3600000000.0, 6) AS working_hours,
               round(matched_points / nullif(micros / 3600000000.0, 0), 6) AS points_per_hour,
               matched_windows,
               round(blocks / nullif(micros / 3600000000.0, 0), 6) AS rounding_sensitivity,
               CAST(gap_points AS DOUBLE) AS gap_points,
               CAST(no_work_points AS DOUBLE) AS no_work_points,
               CAST(boundary_points AS DOUBLE) AS boundary_points, stale_readings,
               array_to_string(quality, ',') AS quality,
               CAST(uncertainty AS DOUBLE) AS uncertainty
        FROM burn_full""",
    "burn_mix": """
        SELECT CAST(day AS VARCHAR) AS day, cohort AS resets_at, model_id, reasoning_level,
               CAST(micros AS BIGINT) AS micros,
               round(micros * 100.0 / sum(micros) OVER (PARTITION BY day, cohort), 6) AS percentage
        FROM (SELECT day, cohort, model_id, reasoning_level, sum(micros) AS micros
              FROM met GROUP BY ALL)""",
    "latest_reading": """
        SELECT at_us, resets_at, CAST(used AS DOUBLE) AS used_percent,
               CAST(100 - used AS DOUBLE) AS remaining_percent
        FROM classed ORDER BY at_us DESC LIMIT 1""",
    "all_time_snapshot": f"""
        SELECT at_us, resets_at, CAST(used AS DOUBLE) AS used_percent,
               CAST(100 - used AS DOUBLE) AS remaining_percent
        FROM judged WHERE verdict = 'accepted'
          AND {us_day('at_us')} = (SELECT max({us_day('at_us')}) FROM quota)
        ORDER BY at_us DESC LIMIT 1""",
    "observed_usage_total": """
        SELECT CAST(sum(matched_points + gap_points + no_work_points) AS DOUBLE) AS observed_points,
               count(DISTINCT cohort) AS cycles,
               CAST(sum(matched_points) AS DOUBLE) AS matched_points,
               CAST(sum(gap_points + no_work_points) AS DOUBLE) AS unmatched_points,
               CAST(sum(boundary_points) AS DOUBLE) AS boundary_points,
               CAST(sum(micros) AS BIGINT) AS matched_micros,
               CAST((SELECT sum(micros) FROM root_daily
                     WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') - sum(micros)
                    AS BIGINT) AS outside_micros
        FROM burn""",
})


STATEMENTS.update({
    "session_list": f"""
        WITH held AS (SELECT session_id, count(DISTINCT model_id || '/' || reasoning_level) AS n,
                any_value(model_id) AS m, any_value(reasoning_level) AS r FROM contexts c
            WHERE at_us = (SELECT max(at_us) FROM contexts d WHERE d.session_id = c.session_id)
            GROUP BY session_id),
        spent AS (SELECT session_id, CAST(sum(micros) AS BIGINT) AS total_micros,
                CAST(coalesce(sum(micros) FILTER (day = DATE '2024-01-20'), 0) AS BIGINT) AS today,
                flatten(list(quality)) AS q FROM root_daily GROUP BY session_id),
        flags AS (SELECT session_id, flatten(list(quality)) AS q, bool_or(e IS NULL) AS unfinished
                  FROM turns GROUP BY session_id)
        SELECT s.id AS session_id, s.title, s.cwd, 'unknown' AS state, s.archived,
               coalesce(today, 0) AS today_micros, coalesce(total_micros, 0) AS total_micros,
               array_to_string(list_sort(list_distinct(list_filter(list_concat(list_concat(
                   s.quality, coalesce(f.q, CAST([] AS VARCHAR[]))), list_concat(
                   coalesce(p.q, CAST([] AS VARCHAR[])),
                   [CASE WHEN unfinished THEN 'unfinished' END,
                    CASE WHEN parent_id IS NOT NULL THEN 'child_excluded' END])),
                   lambda x: x IS NOT NULL))), ',') AS quality,
               CASE WHEN n = 1 THEN m END AS model_id, CASE WHEN n = 1 THEN r END AS reasoning_level
        FROM sessions s LEFT JOIN spent p ON p.session_id = s.id
        LEFT JOIN flags f ON f.session_id = s.id LEFT JOIN held h ON h.session_id = s.id
        WHERE NOT archived AND title LIKE 'User 1%'""",
    "live_extrapolation": """
        SELECT session_id, arg_max(id, s) AS turn_id, 1705751998000000 AS start_us,
               1705752000000000 AS end_us FROM turns
        WHERE e IS NULL AND s <= 1705751998000000 GROUP BY session_id""",
    "top_sessions": """
        (SELECT id AS session_id, CAST(NULL AS BIGINT) AS omitted FROM sessions
         ORDER BY updated DESC, id DESC LIMIT 20)
        UNION ALL SELECT NULL, greatest(count(*) - 20, 0) FROM sessions""",
    "session_status": """
        WITH last AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS u,
                max(turn) FILTER (role = 'assistant') AS a, max(turn) AS t FROM conversations
            GROUP BY conv_id),
        -- A reply closes the open turn; one with an id only the turn right before it,
        -- unless the start has no id, or the turn was closed already.
        closing AS (SELECT c.conv_id, max(c.turn) AS closed FROM conversations c
            WHERE c.role = 'assistant' AND c.conv_id % 2 = 0 AND EXISTS (
                SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn <= c.turn
                  AND x.role = 'assistant'
                  AND NOT EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = c.conv_id
                       AND y.role = 'user' AND y.turn > x.turn AND y.turn < c.turn)
                  AND (c.conv_id % 4 <> 0 OR c.conv_id % 3 = 0 OR coalesce(x.turn - 1 = (
                       SELECT max(z.turn) FROM conversations z WHERE z.conv_id = c.conv_id
                         AND z.role = 'user' AND z.turn < x.turn), TRUE)))
            GROUP BY c.conv_id)
        SELECT '/conv/' || l.conv_id AS file_path,
               CASE WHEN (SELECT min(turn) FROM conversations m WHERE m.conv_id = l.conv_id) = 0
                    THEN 'c' || l.conv_id END AS session_id,
               CASE WHEN (SELECT min(turn) FROM conversations m WHERE m.conv_id = l.conv_id) = 0
                    THEN '/home' END AS cwd,
               CASE WHEN u IS NOT NULL AND (closed IS NULL OR closed < u) THEN 'mid_turn'
                    ELSE 'idle' END AS status,
               (SELECT text FROM conversations m WHERE m.conv_id = l.conv_id AND m.turn = u)
                   AS last_user_message,
               CASE WHEN closed = a THEN 'done: ' ELSE '' END ||
               (SELECT text FROM conversations m WHERE m.conv_id = l.conv_id AND m.turn = a)
                   AS last_assistant_message,
               (1700000000 + t * 60) * 1000000 AS last_updated_us
        FROM last l LEFT JOIN closing k ON k.conv_id = l.conv_id""",
    "message_text": """
        SELECT '/conv/' || conv_id AS file_path, turn * 10 + 3 AS ord, sha256(text) AS digest
        FROM conversations""",
    "heartbeat_fresh": """
        SELECT session_id, max(us) - 60000000 >= 1706659200000000 - 7200000000
               AND max(us) - 60000000 <= 1706659200000000
               AS fresh FROM ev GROUP BY session_id""",
    "calendar_dates": f"""
        SELECT CAST(day AS VARCHAR) AS day, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR)
                   AS week_first,
               CAST(CAST(date_trunc('week', day) AS DATE) + 6 AS VARCHAR) AS week_last,
               CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_first,
               CAST(last_day(day) AS VARCHAR) AS month_last
        FROM (SELECT DISTINCT {us_day('us')} AS day FROM ev)""",
    "local_day_range": f"""
        SELECT CAST(day AS VARCHAR) AS day, {midnight_us('day')} AS opens_us,
               {midnight_us('day + 1')} AS closes_us
        FROM (SELECT DISTINCT {us_day('us')} AS day FROM ev)""",
    "report_dates": f"""
        SELECT CAST({us_day('min(us)')} AS VARCHAR) AS first,
               CAST((SELECT {us_day('max(x)')} FROM (SELECT us AS x FROM ev
                     UNION ALL SELECT e FROM turns UNION ALL SELECT e FROM coverage
                     UNION ALL SELECT at_us FROM quota)) AS VARCHAR) AS last FROM ev""",
    "select_sessions": """
        SELECT id FROM sessions WHERE archived AND (cwd = '/click' OR id IN (
            SELECT session_id FROM turns WHERE cwd = '/click'))""",
    "search_sessions": "SELECT id FROM sessions WHERE title LIKE 'User 12%'",
    "roots_only": "SELECT id FROM roots",
    "exclude_models": """
        SELECT coalesce(model_id = 'm3', FALSE) AS excluded, count(*) AS observations
        FROM usage GROUP BY 1""",
    "normalise_path": """
        SELECT '/a' || cwd AS path, count(*) AS turns FROM turns GROUP BY 1""",
    "text_labels": """
        WITH t AS (SELECT id, cwd, (e - s) AS us, (e - s) // 1000000 AS sec, (e - s) // 1000 AS n
                   FROM turns WHERE e IS NOT NULL)
        SELECT id AS turn_id,
               CASE WHEN us > 0 AND us < 1000000 THEN
                        '0.' || rtrim(lpad(CAST(us AS VARCHAR), 6, '0'), '0') || 's'
                    WHEN sec >= 3600 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm '
                        || (sec % 60) || 's'
                    WHEN sec >= 60 THEN (sec // 60) || 'm ' || (sec % 60) || 's'
                    ELSE sec || 's' END AS duration,
               (sec // 3600) || ':' || lpad(CAST(sec % 3600 // 60 AS VARCHAR), 2, '0') || ':'
                   || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS clock,
               CASE WHEN n >= 1000000 THEN rtrim(rtrim(CAST(CAST(round_even(n / 1000000.0, 2)
                        AS DECIMAL(20, 2)) AS VARCHAR), '0'), '.') || 'M'
                    WHEN n >= 1000 THEN rtrim(rtrim(CAST(CAST(round_even(n / 1000.0, 2)
                        AS DECIMAL(20, 2)) AS VARCHAR), '0'), '.') || 'k'
                    ELSE CAST(n AS VARCHAR) END AS compact,
               'Some work is estimated.' AS note, substr(cwd, 2) AS base
        FROM t""",
})


STATEMENTS.update({
    "quarantine_malformed": """
        SELECT CASE WHEN user_id % 4 = 0 THEN '/archived_sessions/' ELSE '/sessions/' END
                   || session_id AS file_path,
               'malformed rollout record skipped' AS problem, count(*) AS records
        FROM ev WHERE event_id % 101 = 0 GROUP BY 1""",
    "session_upsert": """
        SELECT session_id AS id,
               coalesce((SELECT '/' || event_type FROM ev o WHERE o.user_id = e.user_id
                    AND event_id % 13 <> 0 ORDER BY us DESC LIMIT 1), '/home') AS cwd,
               '' AS title, min(us) - 1000000 AS created_us,
               greatest(max(CASE WHEN event_id % 23 <> 0 OR event_id % 13 <> 0 THEN us END),
                        max(CASE WHEN event_id % 17 <> 0 THEN us + cents * 6000000 END),
                        max(CASE WHEN event_type = 'error' THEN us + k * 10000000 + 300000000 END),
                        min(us) - 1000000) AS updated_us,
               user_id % 4 = 0 AS archived,
               CASE WHEN user_id % 5 = 0 AND user_id > 0 THEN 'u' || (user_id - 1) END AS parent_id,
               user_id % 5 = 0 AND user_id > 0 AS is_child,
               CASE WHEN bool_or(event_id % 23 <> 0) THEN '' ELSE 'no_lifecycle_events' END
                   AS quality
        FROM ev e GROUP BY user_id, session_id""",
    "turn_pairing": """
        SELECT s.session_id, s.turn_id,
               coalesce((SELECT '/' || o.event_type FROM log_turn o WHERE o.user_id = s.user_id
                    AND o.event_id % 13 <> 0 AND (o.us, o.event_id) >= (s.us, s.event_id)
                    AND (CASE WHEN o.event_id % 7 <> 0 THEN o.event_id ELSE o.now_event END)
                        = s.event_id ORDER BY o.us DESC LIMIT 1),
                   (SELECT '/' || o.event_type FROM ev o WHERE o.user_id = s.user_id
                    AND o.event_id % 13 <> 0 AND (o.us, o.event_id) < (s.us, s.event_id)
                    ORDER BY o.us DESC LIMIT 1), '/home') AS cwd,
               s.us AS start_us,
               CASE WHEN s.event_id % 17 <> 0 THEN s.us + s.cents * 6000000
                    ELSE t.us + t.cents * 6000000 END AS end_us,
               CASE WHEN coalesce(t.event_id, s.event_id) % 17 <> 0 THEN
                   CASE WHEN coalesce(t.event_id, s.event_id) % 10 = 1 THEN 'turn_aborted'
                        ELSE 'task_complete' END END AS outcome
        FROM ev s LEFT JOIN log_turn t ON t.user_id = s.user_id AND s.event_id % 17 = 0
          AND t.event_id % 23 = 0 AND t.event_id % 17 <> 0 AND t.event_id % 5 = 0
          AND t.open_event = s.event_id
        WHERE s.event_id % 23 <> 0""",
    "collect_contexts": """
        SELECT DISTINCT session_id,
               lpad(CAST(CASE WHEN event_id % 7 <> 0 THEN event_id ELSE now_event END AS VARCHAR),
                    12, '0') AS turn_id, us AS at_us,
               CASE WHEN event_id % 29 <> 0 THEN 'm' || (event_id % 4) END AS model_id,
               'high' AS reasoning_level
        FROM log_turn WHERE event_id % 13 <> 0
          AND (event_id % 7 <> 0 OR now_event IS NOT NULL)""",
    "wait_pairing": """
        SELECT session_id, lpad(CAST(now_event AS VARCHAR), 12, '0') AS turn_id,
               us + k * 10000000 AS start_us, us + k * 10000000 + 300000000 AS end_us
        FROM log_turn WHERE event_type = 'error' AND now_event IS NOT NULL""",
    "extract_quota": """
        SELECT us AS at_us, 'shared' AS limit_id, 'primary' AS bucket, 1706000000 AS resets_at,
               CAST(CASE WHEN event_id % 31 = 0 THEN 101 ELSE event_id % 100 END AS DOUBLE)
                   AS used_percent, event_id % 31 <> 0 AS valid
        FROM ev WHERE event_type IN ('view', 'click') AND event_id % 3 = 0""",
    "diagnostics_distinct": """
        SELECT 'malformed rollout record skipped' AS reason, count(*) AS occurrences
        FROM ev WHERE event_id % 101 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'model context without stable turn ID skipped', count(*) FROM log_turn
        WHERE event_id % 13 <> 0 AND event_id % 7 = 0 AND now_event IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'terminal event without matching task start skipped', count(*)
        FROM log_turn WHERE event_id % 17 <> 0 AND event_id % 5 = 0 AND now_event IS NULL
        HAVING count(*) > 0""",
    "read_threads": """
        SELECT id, '/meta' AS cwd,
               CASE WHEN n % 2 = 0 THEN (created // 1000 - 5) * 1000
                    ELSE created // 1000000 * 1000000 END AS created_us,
               updated // 1000000 * 1000000 AS updated_us,
               CASE WHEN n % 3 = 0 THEN 'T' || id END AS title, archived, parent_id,
               parent_id IS NOT NULL AS is_child
        FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM sessions) WHERE n % 10 <> 9""",
    "merge_thread_metadata": """
        SELECT id, CASE WHEN n % 10 <> 9 THEN '/meta' ELSE cwd END AS cwd,
               CASE WHEN n % 10 = 7 THEN 'named' WHEN n % 10 <> 9 AND n % 3 = 0 THEN 'T' || id
                    ELSE title END AS title,
               CASE WHEN n % 10 = 9 THEN created WHEN n % 2 = 0 THEN (created // 1000 - 5) * 1000
                    ELSE created // 1000000 * 1000000 END AS created_us, archived,
               CASE WHEN n % 10 = 8 THEN 'u0' ELSE parent_id END AS parent_id,
               parent_id IS NOT NULL OR n % 10 = 8 AS is_child
        FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM sessions)""",
    "merge_precise_over_metadata": """
        SELECT session_id, turn_id,
               CASE WHEN log THEN us ELSE us // 1000000 * 1000000 END AS start_us,
               CASE WHEN log AND event_id % 17 <> 0 THEN us + cents * 6000000
                    ELSE (us // 1000000 + 60) * 1000000 END AS end_us,
               CASE WHEN log AND event_id % 17 <> 0 THEN 'task_complete' ELSE 'done' END AS outcome,
               CASE WHEN NOT log THEN 'historical_upper_bound,metadata_cwd_estimate,'
                        || 'metadata_start_estimate,metadata_reconciled,metadata_end_estimate'
                    WHEN event_id % 17 = 0 THEN 'historical_upper_bound,unfinished_observed_only,'
                        || 'metadata_reconciled,metadata_end_estimate'
                    ELSE 'historical_upper_bound' END AS quality,
               CASE WHEN NOT log THEN 'sqlite' WHEN event_id % 17 = 0 THEN 'rollout,sqlite'
                    ELSE 'rollout' END AS provenance
        FROM (SELECT *, event_id % 3 <> 0 AS log FROM ev)""",
    "append_quota": """
        SELECT at_us, resets_at, CAST(used AS DOUBLE) AS used_percent FROM quota
        WHERE at_us >= 1705276800000000""",
    "append_usage": """
        SELECT session_id, count(*) AS appended FROM usage WHERE at_us >= 1705276800000000
        GROUP BY session_id""",
    "verify_evidence": """
        SELECT 'sessions' AS check, count(*) AS value FROM sessions
        UNION ALL SELECT 'turns', count(*) FROM turns
        UNION ALL SELECT 'session_duplicates', 0
        UNION ALL SELECT 'quota_lines', count(*) FROM quota
        UNION ALL SELECT 'quota_unique', count(*) FROM quota
        UNION ALL SELECT 'usage_lines', count(*) FROM usage
        UNION ALL SELECT 'usage_unique', count(*) FROM usage
        UNION ALL SELECT 'usage_conflicts', 0""",
    "export_report": """
        SELECT id AS turn_id, '["' || array_to_string(quality, '","') || '"]' AS quality
        FROM turns""",
    "report_parity": """
        SELECT id AS turn_id, cwd, 'left' AS side FROM turns WHERE id LIKE '%77'
        UNION ALL SELECT id, '/moved', 'right' FROM turns WHERE id LIKE '%77'""",
    "load_period": f"""
        SELECT 'usage' AS kind, count(*) AS readings FROM usage
        WHERE {us_day('at_us')} = DATE '2024-01-10' HAVING count(*) > 0
        UNION ALL SELECT 'quota', count(*) FROM quota""",
    "samples_to_spans": """
        SELECT session_id, turn_id, kind, start_us, end_us, uncertainty_seconds FROM (
        SELECT p.session_id, t.id AS turn_id, p.kind, greatest(p.before_at, t.s) AS start_us,
               least(p.at_us, coalesce(t.e, p.at_us)) AS end_us,
               greatest(60.0, (p.at_us - p.before_at) / 1000000.0) AS uncertainty_seconds
        FROM poll_pairs p JOIN turns t ON t.session_id = p.session_id AND t.s <= p.at_us
          AND (t.e IS NULL OR t.e >= p.before_at)
        WHERE p.kind IN ('work', 'wait')
        QUALIFY row_number() OVER (PARTITION BY p.session_id, p.at_us
                                   ORDER BY t.s DESC, t.id DESC) = 1)
        WHERE end_us > start_us""",
    "gap_events": """
        SELECT session_id, at_us, reason FROM gap_events""",
    "observation_gap": """
        SELECT id AS turn_id, array_to_string(CASE WHEN EXISTS (
                   SELECT 1 FROM gap_events g WHERE g.session_id = t.session_id AND g.at_us >= t.s
                     AND (t.e IS NULL OR g.at_us < t.e)) AND NOT list_contains(quality, 'observation_gap')
               THEN list_append(quality, 'observation_gap') ELSE quality END, ',') AS quality
        FROM turns t""",
})


STATEMENTS.update({
    "read_rollouts": """
        WITH l AS (
            SELECT 'session_meta' AS kind, '' AS event, min(us) - 1000000 AS at_us FROM ev
            GROUP BY user_id
            UNION ALL SELECT 'gap', '', NULL FROM ev WHERE event_id % 101 = 0
            UNION ALL SELECT 'event_msg', 'task_started', us FROM ev WHERE event_id % 23 <> 0
            UNION ALL SELECT 'turn_context', '', us FROM ev WHERE event_id % 13 <> 0
            UNION ALL SELECT 'response_item', 'function_call', us + k * 10000000 FROM ev
            WHERE event_type = 'error'
            UNION ALL SELECT 'response_item', 'function_call_output',
                             us + k * 10000000 + 300000000 FROM ev WHERE event_type = 'error'
            UNION ALL SELECT 'event_msg', 'token_count', us FROM ev
            WHERE event_type IN ('view', 'click')
            UNION ALL SELECT 'event_msg', CASE WHEN event_id % 10 = 1 THEN 'turn_aborted'
                             ELSE 'task_complete' END, us + cents * 6000000 FROM ev
            WHERE event_id % 17 <> 0)
        SELECT kind, event, count(*) AS records, min(at_us) AS first_us, max(at_us) AS last_us
        FROM l GROUP BY kind, event""",
    "usage_attribution": """
        SELECT session_id, us AS at_us,
               CASE WHEN NOT gap AND (informed OR blind.u IS NULL)
                     AND NOT (cwd_changed AND request IS NULL) THEN raw_cwd END AS cwd,
               CASE WHEN NOT (model_changed AND request IS NULL) THEN held_model END AS model_id,
               lpad(CAST(turn.t AS VARCHAR), 12, '0') AS turn_id, d1 AS input_tokens,
               d6 AS total_tokens, request,
               array_to_string(list_sort(list_filter([lost,
                   CASE WHEN still THEN 'repeated_cumulative_usage' END,
                   CASE WHEN lost IS NULL AND NOT first AND c3 IS NOT NULL AND p3 IS NULL
                        THEN 'category_baseline_unavailable' END,
                   CASE WHEN gap THEN 'source_gap_attribution_unavailable' END,
                   CASE WHEN model_changed AND request IS NULL
                        THEN 'ambiguous_model_attribution' END,
                   CASE WHEN cwd_changed AND request IS NULL
                        THEN 'ambiguous_directory_attribution' END,
                   CASE WHEN held_model IS NULL OR (model_changed AND request IS NULL)
                        THEN 'unknown_model' END,
                   CASE WHEN gap OR NOT (informed OR blind.u IS NULL)
                          OR (cwd_changed AND request IS NULL) THEN 'unknown_directory' END,
                   CASE WHEN d1 IS NOT NULL AND request IS NULL AND NOT still
                        THEN 'request_billing_evidence_unavailable' END],
                   lambda x: x IS NOT NULL)), ',') AS diagnostics
        FROM log_usage""",
})
STATEMENTS["status_transitions"] = (
    "WITH before AS (" + STATEMENTS["session_status"].replace(
        "FROM conversations", "FROM (SELECT * FROM conversations WHERE turn < 1)")
    + "), after AS (" + STATEMENTS["session_status"]
    + ") SELECT file_path FROM after WHERE status = 'idle' AND file_path IN ("
    "SELECT file_path FROM before WHERE status = 'mid_turn')"
)
STATEMENTS["write_daily_records"] = (
    "WITH segs AS (" + STATEMENTS["work_segments"]
    + f"""), cut AS (SELECT *, CAST(unnest(generate_series({us_day('start_us')},
            {us_day('end_us - 1')}, INTERVAL 1 DAY)) AS DATE) AS day FROM segs
            WHERE session_id IN (SELECT id FROM roots))
        SELECT 24 AS digits, CAST(day AS VARCHAR) AS date, session_id,
               greatest(start_us, {midnight_us('day')}) AS start_us,
               least(end_us, {midnight_us('day + 1')}) AS end_us, cwd,
               'session:' || session_id || ',turn:' || replace(turn_ids, ',', ',turn:') AS tags
        FROM cut WHERE least(end_us, {midnight_us('day + 1')})
                       > greatest(start_us, {midnight_us('day')})"""
)

STATEMENTS["rolling_resets"] = """
    WITH v AS (SELECT event_type AS stream, 1706000000 + event_id AS r, row_number() OVER (
                      PARTITION BY event_type ORDER BY us, event_id) AS k FROM ev),
    f AS (SELECT stream, 0::BIGINT AS k, []::BIGINT[] AS a FROM v GROUP BY stream
          UNION ALL
          SELECT f.stream, v.k, CASE WHEN len(list_filter(a, lambda x: abs(x - v.r) <= 10)) > 0 THEN a
                                     ELSE list_append(a, v.r) END
          FROM f JOIN v ON v.stream = f.stream AND v.k = f.k + 1),
    whole AS (SELECT stream, a FROM f QUALIFY k = max(k) OVER (PARTITION BY stream))
    SELECT v.stream, r AS resets_at, list_filter(a, lambda x: abs(x - r) <= 10)[1] AS cohort
    FROM v JOIN whole USING (stream)"""


def _about(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)


def _inside(name: str) -> str:
    return f"SELECT * FROM ({STATEMENTS[name]})"


STATEMENTS["overview"] = f"""
    WITH o_burn AS ({_inside("burn_rows")}), o_mix AS ({_inside("burn_mix")}),
    o_latest AS ({_inside("latest_reading")}), o_models AS ({_inside("model_only_rollup")}),
    o_levels AS ({_inside("model_time_report")})
    SELECT 'allowance' AS part, {_about("day", "resets_at")} AS about, micros AS value,
           CAST(matched_points AS DOUBLE) AS amount FROM o_burn
    UNION ALL SELECT 'mix', {_about("day", "resets_at", "model_id", "reasoning_level")}, micros, percentage FROM o_mix
    UNION ALL SELECT 'latest', {_about("at_us", "resets_at")}, CAST(used_percent AS BIGINT), remaining_percent FROM o_latest
    UNION ALL SELECT 'token_usage', {_about("level", "cwd", "root_id", "child_id", "model_id", "status")},
                     total_tokens, CAST(priced_tokens AS DOUBLE) FROM rollup
    UNION ALL SELECT 'model_totals', {_about("rank", "model_id", "session_count")}, micros, percentage FROM o_models
    UNION ALL SELECT 'reasoning', {_about("rank", "model_id", "reasoning_level", "session_count")}, micros, percentage
    FROM o_levels"""
# The logs end as they are read at once, however they grew.
STATEMENTS["incremental_ingest"] = STATEMENTS["read_rollouts"]
STATEMENTS["maintained_usage"] = STATEMENTS["usage_attribution"]


def oracle_sql() -> dict[str, str]:
    return {name: statement(body) for name, body in STATEMENTS.items()}
