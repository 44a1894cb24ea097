"""The registered queries in DuckDB SQL, over the same tables.

Each statement is written from the operator's definition, with its own window functions
and joins, not from the Spark plan. Queries without a statement are checked by tests.
"""

from __future__ import annotations

from suite.fixtures import AS_OF, AS_OF_MS, MARK_MS, SEED

DAY = f"DATE '{AS_OF}'"

# ---- domain tables, as in suite.fixtures ---------------------------------------------

VIEWS: dict[str, str] = {
    "play_log": """
        SELECT user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS track_id,
               epoch_us(ts) // 1000 AS "timestamp",
               CASE WHEN event_type = 'purchase' THEN 'complete'
                    WHEN event_type IN ('view', 'click') THEN 'listen' ELSE 'skip' END AS action,
               'simulation' AS source, value AS duration, 300.0::DOUBLE AS total_duration,
               ts::DATE AS date_str
        FROM events""",
    "songs": """
        SELECT p_partkey::VARCHAR AS _id, p_name AS track_name, p_brand AS artist_id,
               p_brand AS artist_name, NULL::VARCHAR AS image_url, p_type AS url,
               p_size * 10.0::DOUBLE AS duration, 0 AS plays_7d, 0::BIGINT AS plays_cumulative,
               NULL::DATE AS release_date, text AS lrclib_plain_lyrics,
               NULL::VARCHAR AS lrclib_synced_lyrics,
               CASE WHEN text IS NOT NULL AND p_size <= 40 THEN doc_id END AS lrclib_id,
               p_size <= 40 AS lrclib_fetched,
               CASE WHEN p_size <= 40 THEN text IS NULL END AS lrclib_not_found,
               CASE WHEN p_size <= 40 AND text IS NOT NULL THEN TRUE END AS release_date_checked
        FROM part LEFT JOIN documents ON p_partkey = doc_id""",
    "trend": f"""
        SELECT track_id, count(*) AS plays FROM play_log
        WHERE action IN ('listen', 'complete') AND date_str >= {DAY} - 7 GROUP BY ALL""",
    "counted": """
        SELECT coalesce(p_partkey::VARCHAR, track_id) AS id, coalesce(plays, 0)::BIGINT AS plays
        FROM part FULL JOIN trend ON p_partkey::VARCHAR = track_id""",
    "items": "SELECT vec_id::VARCHAR AS id, embedding FROM embeddings",
    "content": "SELECT id, list_reverse(embedding) AS embedding FROM items",
    "long_v": """
        SELECT id AS user_id, embedding AS vector FROM items
        WHERE id IN (SELECT user_id FROM play_log)""",
    "history": """
        SELECT user_id::VARCHAR AS user_id,
               CASE WHEN event_type = 'error' THEN 'bad'
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
               p_partkey::VARCHAR AS track,
               CASE WHEN event_type = 'click' THEN upper(p_name) ELSE p_name END AS track_name,
               p_brand AS artist
        FROM events JOIN part ON json_extract_string(props, '$.k')::BIGINT = p_partkey""",
    "player_events": """
        SELECT conv_id::VARCHAR AS play_id, turn * 20000 AS ts_ms,
               CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'snapshot'
                    WHEN turn % 2 = 0 THEN 'play' ELSE 'pause' END AS kind
        FROM conversations""",
    "served": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY served_at, id) AS position
        FROM (SELECT user_id, track_id AS id, max("timestamp") AS served_at,
                     bool_and(action = 'skip') AS queued
              FROM play_log GROUP BY ALL)""",
    "alive": f"""
        SELECT * FROM served WHERE user_id IN (
            SELECT user_id FROM served GROUP BY user_id
            HAVING {AS_OF_MS} < max(served_at) + 86400000)""",
    "feed_served": f"""
        SELECT user_id, id, served_at, queued, position FROM alive UNION ALL
        SELECT c_custkey::VARCHAR, k::VARCHAR, {AS_OF_MS}, TRUE, 1000000 + k
        FROM customer, unnest(range(1, 41)) AS r(k)
        WHERE c_custkey % 10 = 1 AND NOT EXISTS (
            SELECT 1 FROM alive a WHERE a.user_id = c_custkey::VARCHAR AND a.id = k::VARCHAR)
        UNION ALL
        SELECT c_custkey::VARCHAR, 'ghost-' || k, {AS_OF_MS}, TRUE, k - 1000
        FROM customer, unnest(range(1, 26)) AS r(k) WHERE c_custkey % 10 = 2 UNION ALL
        SELECT c_custkey::VARCHAR, 'old-' || k, {AS_OF_MS}, FALSE, k - 1000
        FROM customer, unnest(range(1, 501)) AS r(k) WHERE c_custkey % 10 = 3""",
    # Sessions of plays whose track has a vector; w is the play's weight in the average.
    "vec_sessions": """
        SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY "timestamp", track_id
                                    ROWS UNBOUNDED PRECEDING) AS session_no
        FROM (SELECT user_id, track_id, "timestamp",
                     CASE WHEN "timestamp" - lag("timestamp") OVER (
                            PARTITION BY user_id ORDER BY "timestamp", track_id) < 3600000
                          THEN 0 ELSE 1 END AS starts
              FROM play_log WHERE track_id IN (SELECT id FROM items))""",
    "ema": """
        SELECT user_id, session_no, track_id, "timestamp",
               pow(0.7, n - k) * CASE WHEN k = 1 THEN 1.0 ELSE 1.0 - 0.7 END AS w, n
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_no
                                           ORDER BY "timestamp", track_id) AS k,
                     count(*) OVER (PARTITION BY user_id, session_no) AS n
              FROM vec_sessions)""",
    "short_parts": """
        SELECT user_id, session_no, pos, sum(w * x) AS x,
               max("timestamp") AS last_ts, any_value(n) AS n_plays
        FROM (SELECT e.*, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos
              FROM ema e JOIN items i ON e.track_id = i.id)
        GROUP BY user_id, session_no, pos""",
    "short_v": f"""
        SELECT user_id, vector FROM (
            SELECT user_id, session_no, max(last_ts) AS last_ts,
                   list(x ORDER BY pos) AS vector
            FROM short_parts GROUP BY user_id, session_no)
        WHERE {AS_OF_MS} - last_ts >= 0 AND {AS_OF_MS} - last_ts < 3600000
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC) = 1""",
    "session_v": """
        SELECT coalesce(l.user_id, s.user_id) AS user_id, l.vector IS NOT NULL AS has_long,
               CASE WHEN l.vector IS NOT NULL AND s.vector IS NOT NULL THEN
                    list_transform(list_zip(l.vector::DOUBLE[], s.vector),
                                   lambda z: z[1] * 0.7 + z[2] * (1 - 0.7::DOUBLE))
                    ELSE coalesce(l.vector::DOUBLE[], s.vector) END AS vector
        FROM long_v l FULL JOIN short_v s ON l.user_id = s.user_id""",
    "requests": """
        SELECT user_id AS query_id, user_id,
               max_by(track_id, {'t': "timestamp", 'k': track_id}) AS current_song_id
        FROM play_log GROUP BY user_id""",
}


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def sample_hash(user: str, item: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || {user} || '|' || {item}), 1, 8))::BIGINT"


def vector_sums(vec: str) -> str:
    return f"""round(list_sum({vec}::DOUBLE[]), 6) AS v_sum,
        round({dot(vec, vec)}, 6) AS v_square,
        round(list_sum(list_transform({vec}::DOUBLE[], lambda x, i: x * i)), 6) AS v_moment"""


def fallback(wanted: str, seen: str) -> str:
    """Weighted draw from each user's own pool of unseen songs, by definition."""
    return f"""
        SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY key, id) AS rank, n
        FROM (SELECT *, -ln(({sample_hash("user_id", "id")} + 1) / 4294967297.0::DOUBLE)
                        / ln(plays + 2.0::DOUBLE) AS key
              FROM (SELECT w.user_id, w.n, c.id, c.plays,
                           row_number() OVER (PARTITION BY w.user_id
                                              ORDER BY c.plays DESC, c.id) AS place
                    FROM {wanted} w CROSS JOIN counted c
                    WHERE w.n > 0 AND NOT EXISTS (SELECT 1 FROM {seen} s
                                      WHERE s.user_id = w.user_id AND s.id = c.id))
              WHERE place <= greatest(n + 40, floor(n * 1.5)))
        QUALIFY rank <= n"""


VIEWS |= {
    "refills": """
        SELECT user_id, least(100, 500 - g)::BIGINT AS n
        FROM (SELECT c_custkey::VARCHAR AS user_id, coalesce(g, 0) AS g, coalesce(q, 0) AS q
              FROM customer LEFT JOIN (
                  SELECT user_id, count(*) AS g, count_if(queued) AS q
                  FROM feed_served GROUP BY user_id) ON c_custkey::VARCHAR = user_id)
        WHERE q < 20 AND g < 500""",
    "taken": f"""
        SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY h, id) AS rank, quota
        FROM (SELECT *, {sample_hash("user_id", "id")} AS h
              FROM (SELECT r.user_id, i.id,
                           CASE WHEN has_long THEN n ELSE floor(n * 0.5)::BIGINT END AS quota,
                           row_number() OVER (
                               PARTITION BY r.user_id
                               ORDER BY {dot("v.vector::FLOAT[]", "i.embedding")} DESC, i.id) AS place
                    FROM refills r JOIN session_v v ON r.user_id = v.user_id CROSS JOIN items i
                    WHERE NOT EXISTS (SELECT 1 FROM feed_served s
                                      WHERE s.user_id = r.user_id AND s.id = i.id))
              WHERE place <= greatest(floor(quota * CASE WHEN quota <= 50 THEN 3.0 ELSE 1.2 END), 20))
        QUALIFY rank <= quota""",
    "feed_seen": """
        SELECT user_id, id FROM feed_served UNION ALL SELECT user_id, id FROM taken""",
    "shortfall": """
        SELECT r.user_id, r.n - coalesce(g, 0) AS n
        FROM refills r LEFT JOIN (SELECT user_id, count(*) AS g FROM taken GROUP BY user_id) t
          ON r.user_id = t.user_id""",
    "filler": fallback("shortfall", "feed_seen"),
    "feed": """
        SELECT user_id, id, source,
               row_number() OVER (PARTITION BY user_id ORDER BY source, rank) AS rank
        FROM (SELECT user_id, id, 1 AS source, rank FROM taken
              UNION ALL SELECT user_id, id, 2, rank FROM filler)""",
    "long_top": f"""
        SELECT query_id, id, score, rank FROM (
            SELECT l.user_id AS query_id, i.id, {dot("l.vector", "i.embedding")} AS score,
                   row_number() OVER (PARTITION BY l.user_id
                       ORDER BY {dot("l.vector", "i.embedding")} DESC, i.id) AS rank
            FROM long_v l CROSS JOIN items i
            WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.user_id = l.user_id AND s.id = i.id))
        WHERE rank <= 20""",
    "tokens": """
        SELECT id, token, sum(w)::INTEGER AS weight FROM (
            SELECT p_partkey::VARCHAR AS id, 10 AS w,
                   unnest(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+')) AS token FROM part
            UNION ALL
            SELECT p_partkey::VARCHAR, 5,
                   unnest(string_split_regex(lower(p_brand), '[^\\p{L}\\p{N}]+')) FROM part)
        WHERE token <> '' GROUP BY id, token""",
    "asked": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
               count(*) OVER (PARTITION BY query_id) AS n
        FROM (SELECT query_id, id, sum(weight)::BIGINT AS score
              FROM (SELECT DISTINCT p_partkey::VARCHAR AS query_id,
                           unnest(string_split_regex(lower(upper(p_name) || ' ' || p_brand),
                                                     '[^\\p{L}\\p{N}]+')) AS token FROM part) q
              JOIN tokens USING (token) GROUP BY query_id, id)""",
    "payload": """
        SELECT user_id::VARCHAR AS user_id,
               CASE WHEN value >= 1.0 THEN json_extract_string(props, '$.k') END AS track_id,
               CASE WHEN event_type = 'view' THEN NULL ELSE epoch_us(ts) // 1000 END AS ms,
               CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'listen'
                    WHEN 'signup' THEN 'signup' ELSE 'skip' END AS action,
               CASE WHEN event_type = 'click' THEN floor(value) END AS seconds,
               event_type = 'error' AS bad_duration, value > 100.0 AS garbage
        FROM events""",
    "timer": """
        SELECT *, lead(ts_ms) OVER w AS next_ms, lead(kind) OVER w AS next_kind
        FROM player_events WINDOW w AS (PARTITION BY play_id ORDER BY ts_ms)""",
}


def with_views(sql: str, *names: str) -> str:
    """Put the needed views, and the ones they use, in front of a statement."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for other in VIEWS:
            if other != name and _mentions(VIEWS[name], other):
                need(other)
        needed.append(name)

    for name in VIEWS:
        if name in names or _mentions(sql, name):
            need(name)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" + sql


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("FROM", "JOIN") and b == name for a, b in zip(words, words[1:]))


PLAYED = "action IN ('listen', 'complete')"
PICTURE = "'https://ui-avatars.com/api/?name='"
OPTIONS = "&color=fff&size=512&length=1&bold=true"


def picture(name: str, options: str) -> str:
    return f"""{PICTURE} || replace(url_encode({name}), '%2F', '/') || '&background='
        || substr(md5({name}), 1, 6) || '{options}'"""


# Every white-space character, as in earshot.functions.text.
SPACES = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)"
    "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
    "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
    "||chr(8239)||chr(8287)||chr(12288)"
)

REASON = """
    CASE WHEN garbage THEN 'malformed'
         WHEN track_id IS NULL THEN 'track_id missing'
         WHEN action = 'signup' THEN 'action unknown'
         WHEN bad_duration THEN 'duration unreadable' END"""

SQL: dict[str, str] = {
    "trending_7d": """
        SELECT track_id, plays, p_name AS track_name, p_brand AS artist_name
        FROM trend JOIN part ON track_id = p_partkey::VARCHAR""",
    "top_trending": """
        SELECT id AS _id, p_name AS track_name, plays AS plays_7d
        FROM counted LEFT JOIN part ON id = p_partkey::VARCHAR
        ORDER BY plays DESC, id LIMIT 50""",
    "play_counts": f"SELECT track_id, count(*) AS plays FROM play_log WHERE {PLAYED} GROUP BY ALL",
    "max_event_ts": 'SELECT max("timestamp") AS last_timestamp FROM play_log',
    "run_stats": """
        SELECT count(*) AS n_rows, count(DISTINCT user_id || '|' || track_id) AS n_pairs,
               count(DISTINCT user_id) AS n_users, count(DISTINCT track_id) AS n_tracks
        FROM play_log""",
    "play_ratings": f"""
        SELECT user_id, track_id,
               sum(CASE WHEN action = 'complete' THEN 1.0 ELSE 0.5 END)::DOUBLE AS rating
        FROM play_log WHERE {PLAYED} GROUP BY ALL""",
    "daily_trailing_plays": f"""
        SELECT track_id, date_str AS day, plays,
               (sum(plays) OVER (PARTITION BY track_id ORDER BY date_str
                    RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))::BIGINT
                 AS trailing_plays
        FROM (SELECT track_id, date_str, count(*) AS plays FROM play_log
              WHERE {PLAYED} GROUP BY ALL)""",
    "incremental_counts": f"""
        SELECT track_id, count(*) FILTER ({PLAYED}) AS plays,
               (SELECT max("timestamp") FROM play_log WHERE "timestamp" > {MARK_MS}) AS last_timestamp
        FROM play_log WHERE "timestamp" > {MARK_MS} GROUP BY track_id HAVING plays > 0""",
    "add_counts": f"""
        SELECT coalesce(id, track_id) AS _id, (coalesce(c.plays, 0) + coalesce(f.plays, 0))::BIGINT AS plays_7d,
               coalesce(f.plays, 0)::BIGINT AS plays_cumulative
        FROM counted c FULL JOIN (
            SELECT track_id, count(*) AS plays FROM play_log
            WHERE {PLAYED} AND "timestamp" > {MARK_MS} GROUP BY track_id) f ON id = track_id""",
    "event_dates": """
        SELECT user_id, "timestamp", strftime(date_str, '%Y-%m-%d') AS date_str,
               "timestamp" AS event_ms FROM play_log""",
    "plays": f"SELECT * EXCLUDE (date_str) FROM play_log WHERE {PLAYED}",
    "implicit_score": f"""
        SELECT user_id, track_id, "timestamp",
               CASE WHEN action = 'complete' THEN 1.0 ELSE 0.5 END::DOUBLE AS score
        FROM play_log WHERE {PLAYED}""",
    "since_mark": f"""
        SELECT user_id, track_id, "timestamp" FROM play_log WHERE "timestamp" > {MARK_MS}""",
    "validate_events": f"""
        SELECT CASE WHEN NOT garbage THEN user_id END AS user_id,
               CASE WHEN NOT garbage THEN track_id END AS track_id,
               CASE WHEN garbage THEN {AS_OF_MS} ELSE coalesce(ms, {AS_OF_MS}) END::BIGINT AS "timestamp",
               CASE WHEN NOT garbage THEN action END AS action,
               CASE WHEN NOT garbage THEN 'real_user' END AS source,
               CASE WHEN garbage THEN 0 ELSE coalesce(seconds, 0) END::DOUBLE AS duration,
               CASE WHEN garbage THEN 0 ELSE 300 END::DOUBLE AS total_duration,
               {REASON} AS reason
        FROM payload""",
    "encode_events": """
        SELECT user_id, track_id, "timestamp", action, source,
               floor(duration)::DOUBLE AS duration, total_duration FROM play_log""",
    "classify_play": """
        SELECT event_id,
               CASE WHEN event_type = 'purchase' OR value / 300 >= 0.9 THEN 'complete'
                    WHEN value / 300 < 0.5 THEN 'skip' ELSE 'listen' END AS action,
               floor(value)::BIGINT AS duration, 300::BIGINT AS total_duration
        FROM events WHERE value >= 2""",
    "rebase_time": f"""
        SELECT user_id, track_id,
               ("timestamp" + {AS_OF_MS} - 5184000000
                - (SELECT min("timestamp") FROM play_log))::BIGINT AS "timestamp"
        FROM play_log""",
    "replay_events": """
        SELECT user_id, track_id, "timestamp", action, 'simulation' AS source,
               floor(duration)::BIGINT AS duration, floor(total_duration)::BIGINT AS total_duration
        FROM play_log""",
    "sessionize": """
        SELECT user_id, track_id, "timestamp",
               (sum(starts) OVER (PARTITION BY user_id ORDER BY "timestamp"))::BIGINT AS session_no
        FROM (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER (
                    PARTITION BY user_id ORDER BY "timestamp") < 3600000 THEN 0 ELSE 1 END AS starts
              FROM play_log)""",
    "short_term_vectors": f"""
        SELECT user_id, session_no::BIGINT AS session_no, last_ts, n_plays, {vector_sums("vector")}
        FROM (SELECT user_id, session_no, max(last_ts) AS last_ts, max(n_plays) AS n_plays,
                     list(x ORDER BY pos) AS vector
              FROM short_parts GROUP BY user_id, session_no)""",
    "session_vectors": f"SELECT user_id, has_long, {vector_sums('vector')} FROM session_v",
    "listen_time": """
        SELECT play_id, count(*) AS n_events,
               coalesce(sum(next_ms - ts_ms) FILTER (kind = 'play'
                   AND next_kind IN ('pause', 'snapshot')), 0)::BIGINT AS listen_ms
        FROM timer GROUP BY play_id""",
    "qualified_listens": """
        SELECT play_id, min(ts_ms + 30000 - before)::BIGINT AS qualified_ms
        FROM (SELECT *, coalesce(sum(span) OVER (PARTITION BY play_id ORDER BY ts_ms
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM (SELECT *, CASE WHEN kind = 'play' THEN next_ms - ts_ms ELSE 0 END AS span
                    FROM timer))
        WHERE kind = 'play' AND before < 30000 AND before + span >= 30000 GROUP BY play_id""",
    "attach_duration": """
        SELECT user_id, track AS track_id, epoch_us(strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ'))
                 // 1000 AS "timestamp", 'complete' AS action, 'simulation' AS source,
               p_size * 10.0::DOUBLE AS duration, p_size * 10.0::DOUBLE AS total_duration
        FROM history JOIN part ON track = p_partkey::VARCHAR WHERE "timestamp" <> 'bad'""",
    "sort_history": """
        SELECT user_id, track AS track_id,
               epoch_us(strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')) // 1000 AS "timestamp"
        FROM history WHERE "timestamp" <> 'bad'""",
    "extract_users": f"""
        SELECT _id, substr(sha1(_id), 1, 8) AS username, {DAY} AS signup_date,
               {picture("substr(sha1(_id), 1, 8)", OPTIONS + "&font-size=0.7")} AS image_url
        FROM (SELECT DISTINCT user_id AS _id FROM play_log)""",
    "extract_songs": f"""
        SELECT _id, track_name, artist_id, artist_name,
               {picture("track_name", OPTIONS)} AS image_url, 'JfVos4VSpmA' AS url,
               300.0::DOUBLE AS duration
        FROM (SELECT track AS _id, track_name, artist AS artist_id, artist AS artist_name
              FROM history QUALIFY row_number() OVER (PARTITION BY track
                                                      ORDER BY track_name, artist) = 1)""",
    "new_profiles": f"""
        SELECT n_name AS username, {DAY} AS signup_date, 36 AS id_length FROM nation""",
    "resolve_id": """
        SELECT CASE o_orderstatus WHEN 'O' THEN o_orderkey ELSE o_custkey END::VARCHAR AS _id,
               o_totalprice FROM orders WHERE o_orderstatus <> 'P'""",
    "clean_songs": """
        SELECT _id, track_name, artist_name, artist_id, '' AS image_url, url, '0' AS plays_7d,
               '0' AS plays_cumulative, duration::VARCHAR AS duration, release_date,
               coalesce(lrclib_plain_lyrics, '') AS lrclib_plain_lyrics,
               '' AS lrclib_synced_lyrics FROM songs""",
    "song_summary": """
        SELECT _id, track_name, artist_name, artist_id, image_url, url, duration,
               plays_cumulative, release_date FROM songs""",
    "list_users": """
        SELECT c_custkey::VARCHAR AS _id, c_name AS username, NULL::VARCHAR AS image_url
        FROM customer ORDER BY _id LIMIT 100""",
    "enrichment_pending": f"""
        SELECT coalesce(_id, track_id) AS _id, coalesce(plays, 0)::BIGINT AS plays_cumulative
        FROM songs FULL JOIN (SELECT track_id, count(*) AS plays FROM play_log
                              WHERE {PLAYED} GROUP BY track_id) ON _id = track_id
        WHERE NOT coalesce(lrclib_fetched, FALSE) OR NOT coalesce(release_date_checked, FALSE)""",
    "merge_lyrics": f"""
        SELECT _id,
               CASE WHEN found THEN CASE WHEN lang <> 'en' THEN n_chars ELSE 300 END::DOUBLE
                    ELSE duration END AS duration,
               CASE WHEN found THEN {DAY} END AS release_date,
               md5(lrclib_plain_lyrics) AS lyrics_md5,
               CASE WHEN found THEN d.source END AS lrclib_synced_lyrics,
               CASE WHEN found THEN doc_id ELSE lrclib_id END AS lrclib_id,
               CASE WHEN doc_id IS NOT NULL THEN TRUE ELSE lrclib_fetched END AS lrclib_fetched,
               CASE WHEN doc_id IS NOT NULL THEN NOT found ELSE lrclib_not_found END AS lrclib_not_found,
               CASE WHEN found THEN TRUE ELSE release_date_checked END AS release_date_checked
        FROM songs LEFT JOIN (SELECT *, n_chars >= 200 AND text <> '' AS found FROM documents) d
          ON _id = doc_id::VARCHAR""",
    "enrichment_report": """
        SELECT count(*) AS processed, count_if(n_chars >= 200)::BIGINT AS found,
               (count(*) - count_if(n_chars >= 200))::BIGINT AS not_found,
               round(count_if(n_chars >= 200) * 100.0::DOUBLE / count(*), 1) AS success_rate
        FROM documents""",
    "gate_text": f"""
        SELECT doc_id, length(left(text, 5000))::INTEGER AS n_kept, md5(left(text, 5000)) AS text_md5
        FROM documents WHERE length(trim(text, {SPACES})) >= 50""",
    "with_lyrics": """
        SELECT _id, md5(lrclib_plain_lyrics) AS m FROM songs WHERE lrclib_plain_lyrics <> ''""",
    "missing_lyrics_delete": """
        SELECT _id, 'song' AS kind FROM songs WHERE NOT (lrclib_fetched AND
               (lrclib_not_found OR coalesce(lrclib_plain_lyrics, '') = ''))
        UNION ALL
        SELECT id, 'vector' FROM items WHERE id NOT IN (
            SELECT _id FROM songs WHERE lrclib_fetched AND
                   (lrclib_not_found OR coalesce(lrclib_plain_lyrics, '') = ''))""",
    "avatar_url": f"""
        SELECT p_partkey, {picture("n", OPTIONS + "&font-size=0.7")} AS avatar,
               {picture("n", OPTIONS)} AS cover, substr(sha1(p_partkey::VARCHAR), 1, 8) AS username
        FROM (SELECT p_partkey, p_name || ' ~*/&+%é' AS n FROM part)""",
    "durations": """
        SELECT l_orderkey, l_linenumber,
               (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown, s * 1000 AS ms
        FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity * 7.5)::BIGINT AS s FROM lineitem)""",
    "iso_to_ms": """
        SELECT user_id, "timestamp",
               epoch_us(try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')) // 1000 AS ms FROM history""",
    "merge_set_users": f"""
        SELECT coalesce(c_custkey::VARCHAR, k) AS _id,
               CASE WHEN k IS NOT NULL THEN p ELSE c_name END AS username,
               coalesce(d, CASE WHEN c_custkey IS NOT NULL THEN {DAY} END) AS signup_date,
               NULL::VARCHAR AS image_url
        FROM customer FULL JOIN (
            SELECT (o_custkey + 100)::VARCHAR AS k, o_orderpriority AS p,
                   CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS d
            FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
                                                   ORDER BY o_orderkey DESC) = 1)
          ON c_custkey::VARCHAR = k""",
    "merge_inc_counts": """
        SELECT coalesce(p_partkey, l_partkey)::VARCHAR AS _id,
               coalesce(q, 0)::BIGINT AS plays_7d, coalesce(n, 0)::BIGINT AS plays_cumulative
        FROM part FULL JOIN (SELECT l_partkey, sum(l_quantity) AS q, count(*) AS n
                             FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "missing_vectors": """
        SELECT _id FROM songs WHERE _id NOT IN (SELECT id FROM items)""",
    "append_vectors": f"""
        SELECT id, len(embedding)::INTEGER AS dim, {vector_sums("embedding")} FROM (
            SELECT id, embedding FROM items UNION ALL
            SELECT p_partkey::VARCHAR, [p_size::FLOAT FOR i IN range(64)] FROM part
            WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings))""",
    "keep_known": """
        SELECT user_id, track_id AS id, "timestamp" FROM play_log
        WHERE track_id IN (SELECT id FROM items)""",
    "lookup_songs": """
        SELECT _id, track_name FROM songs WHERE _id IN (SELECT track_id FROM play_log)""",
    "profile_table": """
        SELECT (SELECT count(*) FROM songs) AS n_rows, field, CASE WHEN n = 0 THEN 'Null' ELSE t END AS type,
               n AS n_values
        FROM (SELECT unnest(['_id', 'track_name', 'artist_id', 'artist_name', 'image_url', 'url',
                             'duration', 'plays_7d', 'plays_cumulative', 'release_date',
                             'lrclib_plain_lyrics', 'lrclib_synced_lyrics', 'lrclib_id',
                             'lrclib_fetched', 'lrclib_not_found', 'release_date_checked']) AS field,
                     unnest(['string', 'string', 'string', 'string', 'string', 'string', 'double',
                             'int', 'bigint', 'date', 'string', 'string', 'bigint', 'boolean',
                             'boolean', 'boolean']) AS t,
                     unnest([count(_id), count(track_name), count(artist_id), count(artist_name),
                             count(image_url), count(url), count(duration), count(plays_7d),
                             count(plays_cumulative), count(release_date),
                             count(lrclib_plain_lyrics), count(lrclib_synced_lyrics),
                             count(lrclib_id), count(lrclib_fetched), count(lrclib_not_found),
                             count(release_date_checked)]) AS n
              FROM songs)""",
    "preview": """
        SELECT c_custkey::VARCHAR AS _id, c_name AS username FROM customer ORDER BY _id LIMIT 5""",
    "vec_unit": f"""
        SELECT id, {vector_sums("u")} FROM (
            SELECT id, list_transform(embedding::DOUBLE[],
                       lambda x: x / sqrt({dot("embedding", "embedding")})) AS u FROM items)""",
    "vec_lincomb": f"""
        SELECT id, {vector_sums("m")} FROM (
            SELECT i.id, list_transform(list_zip(i.embedding::DOUBLE[], c.embedding::DOUBLE[]),
                       lambda z: z[1] * 0.7 + z[2] * 0.3) AS m
            FROM items i JOIN content c ON i.id = c.id)""",
    "topk_ip": "SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM long_top",
    "exclude_seen": f"""
        SELECT user_id, track_id AS id, "timestamp" FROM play_log p WHERE NOT EXISTS (
            SELECT 1 FROM play_log o WHERE o.date_str >= {DAY} - 7 AND o.user_id = p.user_id
                   AND o.track_id = p.track_id)""",
    "minmax_scores": """
        SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
               round(CASE WHEN hi = lo THEN 1.0 ELSE (l_extendedprice - lo) / (hi - lo) END, 6) AS scaled
        FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS lo,
                     max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem)""",
    "topk_orders": """
        SELECT o_custkey, o_orderkey, o_totalprice,
               row_number() OVER (PARTITION BY o_custkey
                                  ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank
        FROM orders QUALIFY rank <= 3""",
    "seeded_sample": f"""
        SELECT user_id, id, row_number() OVER (PARTITION BY user_id
                   ORDER BY {sample_hash("user_id", "id")}, id)::INTEGER AS rank
        FROM (SELECT DISTINCT l_suppkey::VARCHAR AS user_id, l_partkey::VARCHAR AS id FROM lineitem)
        QUALIFY rank <= 5""",
    "hybrid_rank": f"""
        SELECT coalesce(a.query_id, c.query_id) AS query_id, coalesce(a.id, c.id) AS id,
               round(coalesce(a.s, 0) * 0.6::DOUBLE + coalesce(c.s, 0) * (1 - 0.6::DOUBLE), 6) AS score
        FROM (SELECT query_id, id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s
              FROM long_top WINDOW w AS (PARTITION BY query_id)) a
        FULL JOIN (
              SELECT query_id, id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s
              FROM (SELECT l.user_id AS query_id, i.id, {dot("l.vector", "i.embedding")} AS score
                    FROM long_v l CROSS JOIN content i
                    QUALIFY row_number() OVER (PARTITION BY l.user_id ORDER BY score DESC, i.id) <= 20)
              WINDOW w AS (PARTITION BY query_id)) c
          ON a.query_id = c.query_id AND a.id = c.id""",
    "fallback_songs": "SELECT user_id, id, rank::INTEGER AS rank FROM ("
    + fallback("(SELECT c_custkey::VARCHAR AS user_id, 100 AS n FROM customer)", "served")
    + ")",
    "home_feed": "SELECT user_id, id, source, rank::INTEGER AS rank FROM feed",
    "paginate_feed": """
        SELECT f.user_id, id, f.rank::INTEGER AS rank, ceil(f.rank / 20)::INTEGER AS page,
               (size > ceil(f.rank / 20) * 20 OR coalesce(g, 0) + size < 500)
                 AND count_if(id IN (SELECT p_partkey::VARCHAR FROM part))
                       OVER (PARTITION BY f.user_id, ceil(f.rank / 20)) > 0 AS has_more
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM feed) f
        LEFT JOIN (SELECT user_id, count(*) AS g FROM feed_served GROUP BY user_id) s
          ON f.user_id = s.user_id""",
    "hydrate_feed": """
        SELECT user_id, id, rank::INTEGER AS rank, p_name AS track_name, p_brand AS artist_name,
               p_size * 10.0::DOUBLE AS duration
        FROM feed JOIN part ON id = p_partkey::VARCHAR""",
    "next_songs": None,
    "feed_state": """
        SELECT user_id, count(*) AS n_generated, count_if(queued)::BIGINT AS n_queued
        FROM served GROUP BY user_id""",
    "active_served": "SELECT user_id, id FROM feed_served",
    "mark_served": f"""
        SELECT user_id, id, max(position)::BIGINT AS position, bool_or(queued) AS queued,
               max(served_at)::BIGINT AS served_at
        FROM (SELECT user_id, id, position, queued, served_at FROM served UNION ALL
              SELECT c_custkey::VARCHAR, '5', coalesce(last, 0) + 1, TRUE, {AS_OF_MS}
              FROM customer LEFT JOIN (SELECT user_id, max(position) AS last FROM served
                                       GROUP BY user_id) ON c_custkey::VARCHAR = user_id)
        GROUP BY user_id, id""",
    "hand_out": """
        SELECT user_id, count(*) AS n_generated,
               greatest(0, count_if(queued)
                        - CASE WHEN user_id IN (SELECT user_id FROM play_log) THEN 20 ELSE 0 END
               )::BIGINT AS n_queued
        FROM feed_served GROUP BY user_id""",
    "reset_served": """
        SELECT user_id, id FROM served WHERE user_id NOT IN (SELECT user_id FROM feed_served)""",
    "search_songs": """
        SELECT query_id, id, score, rank::INTEGER AS rank, n > 15 AS has_more
        FROM asked WHERE rank BETWEEN 6 AND 15""",
    "token_index": "SELECT token, id, weight FROM tokens",
    "merge_buckets": f"""
        SELECT id AS _id, name AS track_name,
               CASE WHEN p > 0 THEN p WHEN id NOT LIKE 'x%' THEN 0 END::BIGINT AS plays_7d,
               CASE WHEN p > 0 THEN p WHEN id NOT LIKE 'x%' THEN 0 END::BIGINT AS plays_cumulative
        FROM (SELECT p_partkey::VARCHAR AS id,
                     CASE WHEN p_partkey % 100 = 3 THEN 'new ' || p_partkey ELSE p_name END AS name
              FROM part WHERE p_partkey % 200 <> 11
              UNION ALL SELECT 'x' || p_partkey, 'made' FROM part WHERE p_partkey % 500 = 7)
        LEFT JOIN (SELECT track_id, count(*) AS p FROM play_log WHERE {PLAYED} GROUP BY ALL)
          ON id = track_id""",
    "trailing_days": "SELECT track_id, plays FROM trend",
    "search_regex": """
        SELECT query_id, id, rank::INTEGER AS rank, n > 30 AS has_more
        FROM (SELECT query_id, _id AS id,
                     row_number() OVER (PARTITION BY query_id ORDER BY _id) AS rank,
                     count(*) OVER (PARTITION BY query_id) AS n
              FROM (SELECT 'any' AS query_id, 'ring|WIDGET' AS p UNION ALL
                    SELECT 'start', '^small' UNION ALL SELECT 'brand', 'brand#1\\d')
              JOIN songs ON regexp_matches(track_name, p, 'i') OR regexp_matches(artist_name, p, 'i'))
        WHERE rank BETWEEN 11 AND 30""",
    "idmap_users": f"""
        SELECT user_id AS id, n, (row_number() OVER (ORDER BY n DESC, user_id) - 1)::INTEGER AS idx
        FROM (SELECT user_id, count(*) AS n FROM play_log WHERE {PLAYED} GROUP BY user_id)""",
    "idmap_items": """
        SELECT id, n, (row_number() OVER (ORDER BY n DESC, id) - 1)::INTEGER AS idx
        FROM (SELECT l_partkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY id)""",
    "training_triples": f"""
        SELECT u.idx::INTEGER AS user_index, t.idx::INTEGER AS item_index, rating
        FROM (SELECT user_id, track_id,
                     sum(CASE WHEN action = 'complete' THEN 1.0 ELSE 0.5 END)::DOUBLE AS rating
              FROM play_log WHERE {PLAYED} GROUP BY ALL)
        JOIN (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS idx
              FROM play_log WHERE {PLAYED} GROUP BY user_id) u USING (user_id)
        JOIN (SELECT track_id, row_number() OVER (ORDER BY count(*) DESC, track_id) - 1 AS idx
              FROM play_log WHERE {PLAYED} GROUP BY track_id) t USING (track_id)""",
    "ingest_stream": f"""
        SELECT user_id, track_id, ms AS "timestamp", action, coalesce(seconds, 0)::DOUBLE AS duration,
               300.0::DOUBLE AS total_duration, make_timestamp(ms * 1000)::DATE AS date_str
        FROM payload WHERE {REASON} IS NULL""",
    "count_stream": f"SELECT track_id, count(*) AS plays FROM play_log WHERE {PLAYED} GROUP BY ALL",
    "short_term_stream": f"""
        SELECT user_id, last_ts, {vector_sums("vector")}
        FROM (SELECT user_id, session_no, max(last_ts) AS last_ts, list(x ORDER BY pos) AS vector
              FROM short_parts GROUP BY user_id, session_no)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) = 1""",
    "listen_stream": """
        SELECT play_id, listen_ms, qualified_ms FROM (
            SELECT play_id, coalesce(sum(span) FILTER (kind = 'play'), 0)::BIGINT AS listen_ms,
                   min(ts_ms + 30000 - before) FILTER (kind = 'play' AND before < 30000
                       AND before + span >= 30000)::BIGINT AS qualified_ms
            FROM (SELECT *, coalesce(sum(span) OVER (PARTITION BY play_id ORDER BY ts_ms
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                  FROM (SELECT *, CASE WHEN kind = 'play' THEN next_ms - ts_ms ELSE 0 END AS span
                        FROM timer))
            GROUP BY play_id)""",
}


def _next_list(vectors: str, table: str) -> str:
    """One scaled candidate list; ``vectors`` holds ``(query_id, vector)``."""
    return f"""
        SELECT query_id, id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s
        FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo,
                     max(score) OVER (PARTITION BY query_id) AS hi
              FROM (SELECT q.query_id, i.id, {dot("v.vector::FLOAT[]", "i.embedding")} AS score, q.n
                    FROM room q JOIN {vectors} v ON q.query_id = v.query_id CROSS JOIN {table} i
                    WHERE i.id <> q.current_song_id AND NOT EXISTS (
                        SELECT 1 FROM served s WHERE s.user_id = q.user_id AND s.id = i.id)
                    QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, i.id)
                            <= greatest(floor(q.n * 3.0), 15)))"""


VIEWS |= {
    "room": """
        SELECT r.*, least(50, 200 - g)::BIGINT AS n
        FROM requests r JOIN (SELECT user_id, count(*) AS g, count_if(queued) AS q
                              FROM served GROUP BY user_id) s ON r.user_id = s.user_id
        WHERE q < 15 AND g < 200""",
    "tastes": "SELECT user_id AS query_id, vector FROM session_v",
    "playing": """
        SELECT query_id, embedding AS vector FROM requests JOIN content ON current_song_id = id""",
    "als_list": _next_list("tastes", "items"),
    "content_list": _next_list("playing", "content"),
    "merged": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM (SELECT coalesce(a.query_id, c.query_id) AS query_id, coalesce(a.id, c.id) AS id,
                     coalesce(a.s, 0) * 0.6::DOUBLE + coalesce(c.s, 0) * (1 - 0.6::DOUBLE) AS score
              FROM als_list a FULL JOIN content_list c ON a.query_id = c.query_id AND a.id = c.id)""",
    "lost": """
        SELECT query_id AS user_id, n FROM room
        WHERE query_id NOT IN (SELECT query_id FROM merged)""",
}

SQL["next_songs"] = f"""
    SELECT m.query_id, m.id, round(score, 6) AS score, rank::INTEGER AS rank
    FROM merged m JOIN room r ON m.query_id = r.query_id WHERE rank <= r.n
    UNION ALL
    SELECT user_id, id, NULL, rank::INTEGER FROM ({fallback("lost", "served")})"""


LISTENED = f"(SELECT DISTINCT user_id FROM play_log WHERE {PLAYED})"
TRACKS = f"(SELECT DISTINCT track_id FROM play_log WHERE {PLAYED})"
KEPT = """(SELECT _id FROM songs WHERE NOT (lrclib_fetched AND
           (lrclib_not_found OR coalesce(lrclib_plain_lyrics, '') = '')))"""
DROPPED = """(SELECT _id FROM songs WHERE lrclib_fetched AND
              (lrclib_not_found OR coalesce(lrclib_plain_lyrics, '') = ''))"""

VIEWS |= {
    "next_ranked": """
        SELECT m.query_id, m.id, m.score, m.rank
        FROM merged m JOIN room r ON m.query_id = r.query_id WHERE rank <= r.n""",
    "found": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
               count(*) OVER (PARTITION BY query_id) AS n
        FROM (SELECT query_id, id, sum(weight) AS score
              FROM (SELECT DISTINCT query_id,
                           unnest(string_split_regex(lower(p_brand), '[^\\p{L}\\p{N}]+')) AS token
                    FROM requests JOIN part ON current_song_id = p_partkey::VARCHAR) q
              JOIN tokens USING (token) GROUP BY query_id, id)""",
}

SQL |= {
    "lake_trending": "SELECT track_id, plays FROM trend",
    "jsonl_round_trip": """
        SELECT _id, track_name, duration, 0::BIGINT AS plays_7d, release_date,
               md5(coalesce(lrclib_plain_lyrics, '')) AS lyrics_md5 FROM songs""",
    "publish_vectors": f"SELECT id, {vector_sums('embedding')} FROM content",
    "prepare_history": """
        SELECT user_id, track AS track_id,
               epoch_us(strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')) // 1000 AS "timestamp",
               p_size * 10.0::DOUBLE AS duration
        FROM history JOIN part ON track = p_partkey::VARCHAR WHERE "timestamp" <> 'bad'
        UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL FROM history WHERE "timestamp" <> 'bad'""",
    "sync_master": f"""
        SELECT coalesce(c_custkey::VARCHAR, user_id) AS _id,
               CASE WHEN user_id IS NULL THEN c_name ELSE substr(sha1(user_id), 1, 8) END AS username,
               {DAY} AS signup_date
        FROM customer FULL JOIN (SELECT DISTINCT user_id FROM play_log)
          ON c_custkey::VARCHAR = user_id""",
    "run_incremental": f"""
        SELECT coalesce(p_partkey::VARCHAR, track_id) AS _id, coalesce(plays, 0)::BIGINT AS plays_cumulative
        FROM part FULL JOIN (SELECT track_id, count(*) AS plays FROM play_log
                             WHERE {PLAYED} GROUP BY track_id) ON p_partkey::VARCHAR = track_id""",
    "rejected_lines": """
        SELECT CASE p_partkey % 3 WHEN 0 THEN 'broken ' || p_partkey
                                  ELSE '{"track_name":"' || p_partkey || '"}' END AS line,
               CASE p_partkey % 3 WHEN 0 THEN 'malformed' ELSE 'id missing' END AS reason
        FROM part WHERE p_partkey % 3 < 2""",
    "read_history": 'SELECT user_id, track_id, "timestamp", action FROM play_log',
    "load_vectors": f"SELECT id, {vector_sums('embedding')} FROM items",
    "conform_times": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_ms(date_trunc('second', ts)) END AS ms
        FROM events""",
    "is_empty": """
        SELECT a.action, count(p.action) = 0 AS empty
        FROM (SELECT unnest(['listen', 'skip', 'complete', 'never']) AS action) a
        LEFT JOIN play_log p ON a.action = p.action GROUP BY a.action""",
    "batch_encoder": """
        SELECT id, round(avg(length(w))::FLOAT::DOUBLE, 6) AS x0,
               round(avg(length(w) - length(replace(w, 'e', '')))::FLOAT::DOUBLE, 6) AS x1,
               round(avg(length(w) - length(replace(w, ' ', '')))::FLOAT::DOUBLE, 6) AS x2
        FROM (SELECT id, substr(text, i * 500 + 1, 500) AS w
              FROM gated, unnest(range(0, ((length(text) + 499) // 500)::BIGINT)) AS r(i))
        GROUP BY id""",
    "fold_stream_counts": f"""
        SELECT coalesce(p_partkey::VARCHAR, track_id) AS _id, coalesce(plays, 0)::BIGINT AS plays_cumulative
        FROM part FULL JOIN (SELECT track_id, count(*) AS plays FROM play_log
                             WHERE {PLAYED} GROUP BY track_id) ON p_partkey::VARCHAR = track_id""",
    "run_nightly": f"""
        SELECT 'song' AS kind, id, plays AS n FROM counted UNION ALL
        SELECT 'user', coalesce(c_custkey::VARCHAR, user_id), CASE WHEN user_id IS NULL THEN 0 ELSE 64 END
        FROM customer FULL JOIN {LISTENED} ON c_custkey::VARCHAR = user_id UNION ALL
        SELECT 'item', track_id, 64 FROM {TRACKS}""",
    "als_factors": f"""
        SELECT 'item' AS kind, track_id AS id, 64 AS dim, TRUE AS not_negative, TRUE AS not_zero
        FROM {TRACKS} UNION ALL
        SELECT 'user', user_id, 64, TRUE, TRUE FROM {LISTENED}""",
    "als_recommend": f"""
        SELECT user_id, rank::INTEGER AS rank, TRUE AS is_product, TRUE AS falls, TRUE AS bounded
        FROM {LISTENED}, unnest(range(1, 1 + least(10, (SELECT count(*) FROM {TRACKS})))) AS r(rank)""",
    "kept_sessions": f"""
        SELECT user_id, session_no::BIGINT AS session_no, last_ts, n_plays, {vector_sums("vector")}
        FROM (SELECT user_id, session_no, max(last_ts) AS last_ts, max(n_plays) AS n_plays,
                     list(x ORDER BY pos) AS vector
              FROM short_parts GROUP BY user_id, session_no)""",
    "approx_recall": """
        SELECT unnest(['given', 'clustered']) AS vectors, count(*) AS n_queries, TRUE AS reached
        FROM long_v WHERE user_id::BIGINT % 2 = 1""",
    "als_half_step": f"SELECT user_id, 64 AS dim, TRUE AS agrees, TRUE AS not_negative FROM {LISTENED}",
    "content_vectors": """
        SELECT gated.id, round(coalesce(sum(v), 0), 6) AS v_sum,
               round(coalesce(sum(v * v), 0), 6) AS v_square,
               round(coalesce(sum(v * (bucket + 1)), 0), 6) AS v_moment
        FROM gated LEFT JOIN unit_parts ON gated.id = unit_parts.id GROUP BY gated.id""",
    "build_content": f"""
        SELECT id, 384 AS dim, round(6 * {dot("embedding", "embedding")}, 3) AS square
        FROM content UNION ALL
        SELECT _id, 384, 1.0::DOUBLE FROM songs
        WHERE length(trim(lrclib_plain_lyrics, {SPACES})) >= 50 AND _id NOT IN (SELECT id FROM content)""",
    "clean_catalogue": f"""
        SELECT _id AS id, 0 AS part FROM {KEPT} UNION ALL SELECT _id, 3 FROM {KEPT} UNION ALL
        SELECT id, 1 FROM items WHERE id NOT IN {DROPPED} UNION ALL
        SELECT id, 2 FROM content WHERE id NOT IN {DROPPED}""",
    "serve_batch": f"""
        SELECT kind, query_id, id, rank::INTEGER AS rank, has_more FROM (
            SELECT 'feed' AS kind, user_id AS query_id, id, place AS rank,
                   waiting > 20 OR generated < 500 AS has_more FROM feed_line WHERE place <= 20
            UNION ALL
            SELECT 'next', user_id, id, place, waiting > 20 OR generated < 200
            FROM next_line WHERE place <= 20 UNION ALL
            SELECT 'search', query_id, id, rank, n > 20 FROM found WHERE rank <= 20)
        WHERE id IN (SELECT id FROM counted)""",
}


VIEWS |= {
    "gated": f"""
        SELECT _id AS id, lrclib_plain_lyrics AS text FROM songs
        WHERE length(trim(lrclib_plain_lyrics, {SPACES})) >= 50""",
    "buckets": """
        SELECT id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 384) AS bucket, count(*) AS n
        FROM (SELECT id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word
              FROM gated) WHERE word <> '' GROUP BY ALL""",
    "rarity": """
        SELECT bucket, ln(((SELECT count(*) FROM gated) + 1) / (count(*) + 1)) AS r
        FROM buckets GROUP BY bucket""",
    "unit_parts": """
        SELECT id, bucket, (x / CASE WHEN l > 0 THEN l ELSE 1 END)::FLOAT::DOUBLE AS v
        FROM (SELECT id, b.bucket, n * r AS x,
                     sqrt(sum((n * r) * (n * r)) OVER (PARTITION BY id)) AS l
              FROM buckets b JOIN rarity ON b.bucket = rarity.bucket)""",
}


def _line(name: str, state: str, batch: str) -> None:
    """A session table's waiting ids in order after its refill, for everyone who listens."""
    VIEWS[name] = f"""
        SELECT l.*, coalesce(g, 0) + coalesce(b, 0) AS generated FROM (
            SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY position, id) AS place,
                   count(*) OVER (PARTITION BY user_id) AS waiting
            FROM (SELECT user_id, id, position FROM {state} WHERE queued UNION ALL
                  SELECT b.user_id, b.id, coalesce(last, 0) + b.rank
                  FROM {batch} b LEFT JOIN (SELECT user_id, max(position) AS last FROM {state}
                                            GROUP BY user_id) e ON b.user_id = e.user_id)) l
        LEFT JOIN (SELECT user_id, count(*) AS b FROM {batch} GROUP BY user_id) n
          ON l.user_id = n.user_id
        LEFT JOIN (SELECT user_id, count(*) AS g FROM {state} GROUP BY user_id) s
          ON l.user_id = s.user_id
        WHERE l.user_id IN (SELECT user_id FROM play_log)"""


VIEWS["next_batch"] = f"""
    SELECT query_id AS user_id, id, rank FROM next_ranked UNION ALL
    SELECT user_id, id, rank FROM ({fallback("lost", "served")})"""
_line("feed_line", "feed_served", "feed")
_line("next_line", "served", "next_batch")


def statements() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
