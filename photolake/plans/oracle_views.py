"""The derived views as DuckDB SQL, for ``oracle_sql()``."""

from __future__ import annotations

from photolake.functions.fixed import STYLE_LABELS, TAG_SYNONYMS
from photolake.sources.tables import ERROR_TYPES, FORMATS, POST_TAGS


def lst(values) -> str:
    return "[" + ",".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _synonym_rows() -> str:
    rows = [f"('{k}','{s}')" for k, words in TAG_SYNONYMS.items() for s in words]
    return ",".join(rows)


_FMT = f"({lst(FORMATS)})[(doc_id%6)::INT+1]"
_T1 = f"({lst(POST_TAGS)})[(e.event_id%12)::INT+1]"
_T2 = f"({lst(POST_TAGS)})[(e.user_id%12)::INT+1]"
_HEX = "'0123456789ABCDEF'"

# name -> (views it needs, body)
VIEWS: dict[str, tuple[str, str]] = {
    "posts": ("", f"""
        SELECT e.event_id AS post_id, d.source AS blog,
         CASE e.event_type WHEN 'signup' THEN 'text' WHEN 'error' THEN 'video' ELSE 'photo' END AS type,
         e.ts AS post_ts, CAST(floor(e.value) AS INT) AS likes,
         CAST(json_extract_string(e.props,'$.k') AS INT) AS note_count, coalesce(l.toxic,0)=1 AS is_nsfw,
         CASE WHEN e.event_id%12=e.user_id%12 THEN [{_T1}] ELSE [{_T1},{_T2}] END AS tags,
         CASE WHEN e.event_id%17=0 THEN [] ELSE list_transform(range(0,e.event_id%3+1),
          lambda i: {{'url': concat('https://',d.source,'.example.com/img/',d.doc_id,'_',i,'.jpg')}}) END AS photos
        FROM events e JOIN documents d ON d.doc_id=e.event_id%(SELECT count(*) FROM documents)
        LEFT JOIN labels l ON l.doc_id=d.doc_id"""),
    "images": ("", f"""
        SELECT doc_id AS image_id, concat('/img/',coalesce('class'||label,'unlabelled'),'/',doc_id,'.',{_FMT}) AS path, width,
         CAST(greatest(1,ceil(ceil(length/3)/width)) AS INT) AS height, length, {_FMT} AS format, doc_id*7919%100003 AS atime
        FROM (SELECT doc_id, length, CAST(greatest(1,ceil(sqrt(ceil(length/3)))) AS INT) AS width
              FROM (SELECT doc_id, coalesce(strlen(text),0)::BIGINT AS length FROM documents))
        LEFT JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id)"""),
    # bytes of the whole text, as a list of 0..255
    "doc_bytes": ("", f"""
        SELECT doc_id, n, CAST(ceil(sqrt(ceil(n/3.0))) AS INT) AS width, ceil(n/3.0) AS npx,
         list_transform(range(0,n), lambda k: (instr({_HEX}, hx[2*k+1])-1)*16+instr({_HEX}, hx[2*k+2])-1) AS b
        FROM (SELECT doc_id, strlen(text) AS n, string_split(hex(encode(text)),'') AS hx FROM documents
              WHERE strlen(text)>0)"""),
    "raw_px": ("doc_bytes", """
        SELECT doc_id AS image_id, width, height, p//width AS y, p%width AS x, pix[1] AS r, pix[2] AS g, pix[3] AS b
        FROM (SELECT doc_id, width, height, unnest(range(0,width*height)) AS p,
               unnest(list_transform(range(0,width*height),
                lambda q: [b[(3*q)%n+1], b[(3*q+1)%n+1], b[(3*q+2)%n+1]])) AS pix
              FROM (SELECT *, CAST(ceil(npx/width) AS INT) AS height FROM doc_bytes))"""),
    # whole images, as pixels
    "pix": ("raw_px", """
        SELECT image_id, width, height, width AS w, height AS h, CAST(y AS INT) AS y, CAST(x AS INT) AS x, r, g, b,
         CAST((299*r+587*g+114*b+500)//1000 AS INT) AS gray, r*65536+g*256+b AS packed FROM raw_px"""),
    # at most 100 x 100: means weighted by the area that a pixel and a cell share
    "pix100": ("raw_px", """
        SELECT image_id, CAST(cy AS INT) AS y, CAST(cx AS INT) AS x, CAST((2*sum(r*wt)+n)//(2*n) AS INT) AS r,
         CAST((2*sum(g*wt)+n)//(2*n) AS INT) AS g, CAST((2*sum(b*wt)+n)//(2*n) AS INT) AS b FROM (
          SELECT image_id, cy, cx, r, g, b, (width*height)::BIGINT AS n,
           (least((cy+1)*height,(y+1)*least(height,100))-greatest(cy*height,y*least(height,100)))
           *(least((cx+1)*width,(x+1)*least(width,100))-greatest(cx*width,x*least(width,100))) AS wt FROM (
           SELECT *, unnest(range(x*least(width,100)//width, ((x+1)*least(width,100)-1)//width+1)) AS cx FROM (
            SELECT *, unnest(range(y*least(height,100)//height, ((y+1)*least(height,100)-1)//height+1)) AS cy FROM raw_px)))
        GROUP BY image_id, cy, cx, n"""),
    "gray8": ("", """
        SELECT vec_id AS image_id, CAST((p-1)//8 AS INT) AS y, CAST((p-1)%8 AS INT) AS x, 8 AS w, 8 AS h,
         CAST(floor((CAST(embedding[p] AS DOUBLE)+1.0::DOUBLE)*127.5::DOUBLE) AS INT) AS gray
        FROM embeddings, range(1,65) t(p)"""),
    # mirrored Laplacian and Sobel by windows, over pix
    "stencil": ("pix", """
        SELECT *, right_s-left_s AS gx, down_t-up_t AS gy FROM (
         SELECT *, coalesce(lag(s) OVER cx, lead(s) OVER cx, s) AS left_s,
          coalesce(lead(s) OVER cx, lag(s) OVER cx, s) AS right_s,
          coalesce(lag(t) OVER cy, lead(t) OVER cy, t) AS up_t,
          coalesce(lead(t) OVER cy, lag(t) OVER cy, t) AS down_t FROM (
          SELECT *, u+d+l+rt-4*gray AS lap, u+2*gray+d AS s, l+2*gray+rt AS t FROM (
           SELECT *, coalesce(lag(gray) OVER wx, lead(gray) OVER wx, gray) AS l,
            coalesce(lead(gray) OVER wx, lag(gray) OVER wx, gray) AS rt,
            coalesce(lag(gray) OVER wy, lead(gray) OVER wy, gray) AS u,
            coalesce(lead(gray) OVER wy, lag(gray) OVER wy, gray) AS d
           FROM pix WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)))
          WINDOW cx AS (PARTITION BY image_id, y ORDER BY x), cy AS (PARTITION BY image_id, x ORDER BY y))"""),
    "hashes": ("", """
        WITH base AS (SELECT vec_id AS image_id, CAST(sum(CASE WHEN NOT embedding[p]>0 THEN 0::HUGEINT
          WHEN p=64 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << (p-1)::INT END) AS BIGINT) AS h
          FROM embeddings, range(1,65) t(p) GROUP BY vec_id)
        SELECT image_id, h FROM base UNION ALL
        SELECT image_id+1000000000, xor(h, ((1::BIGINT << (image_id%9)::INT)-1)::BIGINT) FROM base"""),
    "boxes": ("", """
        SELECT user_id AS image_id, event_id AS box_id, CAST(event_id*7%40 AS INT) AS x,
         CAST(event_id*11%40 AS INT) AS y, CAST(20+json_extract_string(props,'$.k')::INT AS INT) AS w,
         CAST(20+event_id%90 AS INT) AS h, (event_id*13%100)/100.0::DOUBLE AS confidence,
         CASE WHEN event_type IN ('view','click') THEN 'cascade' WHEN event_type='error' THEN 'haar' ELSE 'dnn' END
          AS method, CAST(event_id%3 AS INT) AS eyes FROM events"""),
    "attempts": ("", f"""
        SELECT event_id AS attempt_id, concat('https://u',user_id,'.example.com/',event_id%40,'.png') AS url, ts,
         CAST(event_id%4 AS INT) AS attempt, CASE event_type WHEN 'error' THEN 'failed'
          WHEN 'signup' THEN 'skipped_duplicate' ELSE 'success' END AS outcome,
         CASE WHEN event_type='error' THEN ({lst(ERROR_TYPES)})[(event_id%5)::INT+1] END AS error_type FROM events"""),
    "predictions": ("", f"""
        SELECT vec_id AS image_id, ({lst(STYLE_LABELS)})[p] AS label, part[p]/list_sum(part) AS confidence,
         ({lst(STYLE_LABELS)})[label+1] AS true_label
        FROM (SELECT vec_id, label, list_transform(mean, lambda m: (m*m)*(m*m)) AS part FROM (SELECT vec_id, label,
         list_transform(range(1,11), lambda c: list_sum(list_transform(embedding[c:len(embedding):10],
          lambda z: 1.0::DOUBLE+z)) / len(embedding[c:len(embedding):10])) AS mean FROM embeddings)), range(1,11) t(p)"""),
    "synonyms": ("", f"SELECT * FROM (VALUES {_synonym_rows()}) v(key, synonym)"),
    # tag word (lower case) -> every word it expands to
    "expansion": ("synonyms", """
        SELECT DISTINCT m.word, o.word AS expanded FROM
         (SELECT key, lower(key) AS word FROM synonyms UNION SELECT key, lower(synonym) FROM synonyms) m
         JOIN (SELECT key, key AS word FROM synonyms UNION SELECT key, synonym FROM synonyms) o USING (key)"""),
    "post_tags": ("posts", "SELECT post_id, unnest(tags) AS tag FROM posts"),
    "photo_rows": ("posts", """
        SELECT post_id, blog, type, post_ts, likes, note_count, is_nsfw, tags, unnest(photos).url AS url FROM posts"""),
}

H32 = "CAST(concat('0x', substr(md5({0}),1,8)) AS BIGINT)"


def h32(expr: str) -> str:
    return H32.format(f"CAST({expr} AS VARCHAR)")


def with_views(names: str, sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0].split():
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
