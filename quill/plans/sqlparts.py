"""DuckDB SQL fragments (CTEs) mirroring the Spark operators, used by the
oracle queries in ``__spark_entry__.oracle_sql``.  Each function returns
``name AS (...)`` text to be joined into one ``WITH`` clause.
"""

from __future__ import annotations

from quill.functions import text as T
from quill.functions.hashing import hash_draw_sql, hash_key_sql
from quill.operators.clean import LEXICON_MIN_DF, NOUN_RULES
from quill.sources.tables import TURN_BASE, documents_label_sql


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def docs(name: str = "docs", label: str = "lang") -> str:
    return (f"{name} AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, "
            f"{documents_label_sql(label)} AS label FROM documents)")


def conv_docs(name: str = "cdocs") -> str:
    return (f"{name} AS (SELECT CAST(conv_id * {TURN_BASE} + turn AS BIGINT) AS doc_id, "
            f"CAST(conv_id AS BIGINT) AS conv_id, text, CAST(role AS VARCHAR) AS label FROM conversations)")


def clean_arrays(name: str = "ct", src: str = "docs") -> str:
    return f"{name} AS (SELECT doc_id, label, {T.clean_tokens_sql('text')} AS tokens FROM {src})"


def long_tokens(name: str = "tl", src: str = "ct") -> str:
    return (f"{name} AS (SELECT doc_id, label, unnest(tokens) AS token, "
            f"generate_subscripts(tokens, 1) - 1 AS pos FROM {src})")


def lexicon(name: str = "lex", src: str = "tl") -> str:
    return (f"{name} AS (SELECT token AS word FROM (SELECT DISTINCT doc_id, token FROM {src}) "
            f"GROUP BY token HAVING count(*) >= {LEXICON_MIN_DF})")


def lemma_map(name: str = "lm", src: str = "tl", lex: str = "lex") -> str:
    parts = [f"SELECT token, token AS cand FROM {name}_w"]
    for old, new in NOUN_RULES:
        parts.append(
            f"SELECT token, substr(token, 1, length(token) - {len(old)}) || '{new}' AS cand "
            f"FROM {name}_w WHERE suffix(token, '{old}')")
    return (f"{name}_w AS (SELECT DISTINCT token FROM {src}),\n"
            f"{name}_c AS ({' UNION ALL '.join(parts)}),\n"
            f"{name} AS (SELECT token, lemma FROM ("
            f"SELECT token, first(cand ORDER BY length(cand), cand) AS lemma FROM {name}_c "
            f"WHERE cand IN (SELECT word FROM {lex}) GROUP BY token) WHERE lemma <> token)")


def lemmatized(name: str = "tll", src: str = "tl", lm: str = "lm") -> str:
    return (f"{name} AS (SELECT t.doc_id, t.label, t.pos, coalesce(m.lemma, t.token) AS token "
            f"FROM {src} t LEFT JOIN {lm} m ON t.token = m.token)")


def clean_corpus(name: str = "cc", arrays: str = "ct", toks: str = "tll") -> str:
    return (f"{name} AS (SELECT a.doc_id, a.label, CAST(count(t.token) AS BIGINT) AS n_tokens, "
            f"coalesce(string_agg(t.token, ' ' ORDER BY t.pos), '') AS processed_content "
            f"FROM {arrays} a LEFT JOIN {toks} t ON a.doc_id = t.doc_id GROUP BY a.doc_id, a.label)")


def full_clean(label: str = "lang") -> list[str]:
    """docs -> ct -> tl -> lex -> lm -> tll -> cc."""
    return [docs("docs", label), clean_arrays(), long_tokens(), lexicon(), lemma_map(), lemmatized(),
            clean_corpus()]


def nonempty(name: str = "ne", arrays: str = "ct") -> str:
    return f"{name} AS (SELECT doc_id, label FROM {arrays} WHERE len(tokens) > 0)"


def _quota(name: str, src: str, stratum: str, side_frac: float) -> str:
    return f"""{name} AS (
  SELECT {stratum}, n_c, n_first, feasible,
         base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {stratum}) <= n_first - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT *, (n_c * n_first) // n AS base, (n_c * n_first) % n AS rem,
               (min_c >= 2 AND n_first >= n_strata AND n - n_first >= n_strata) AS feasible
        FROM (SELECT *, n - CAST(ceil(CAST({float(side_frac)!r} AS DOUBLE) * n) AS BIGINT) AS n_first
              FROM (SELECT {stratum}, n_c, sum(n_c) OVER () AS n, count(*) OVER () AS n_strata, min(n_c) OVER () AS min_c
                    FROM (SELECT {stratum}, count(*) AS n_c FROM {src} GROUP BY {stratum})))))"""


def _cut(name: str, src: str, stratum: str, side_frac: float, stage: str, first: str,
         second: str, out: str, seed: int = 42) -> str:
    q = f"{name}_q"
    return (_quota(q, src, stratum, side_frac) + ",\n" +
            f"""{name} AS (
  SELECT r.* EXCLUDE (grp, quota_, hk, feasible, quota, n_c, n_first),
         CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY hk, doc_id) <= quota_ THEN '{first}' ELSE '{second}' END AS {out}
  FROM (SELECT s.*, q.*  EXCLUDE ({stratum}),
               CASE WHEN q.feasible THEN s.{stratum} ELSE '__all__' END AS grp,
               CASE WHEN q.feasible THEN q.quota ELSE q.n_first END AS quota_,
               {hash_key_sql(seed, stage, '@s.doc_id')} AS hk
        FROM {src} s JOIN {q} q ON s.{stratum} = q.{stratum}) r)""")


def collapse(name: str, src: str, in_expr: str, min_count: int, rare: str, out: str) -> str:
    return (f"{name} AS (SELECT s.*, CASE WHEN c.n < {min_count} THEN '{rare}' ELSE s._src END AS {out} "
            f"FROM (SELECT *, {in_expr} AS _src FROM {src}) s JOIN "
            f"(SELECT {in_expr} AS _src, count(*) AS n FROM {src} GROUP BY 1) c ON s._src = c._src)")


def splits(name: str = "splits", src: str = "ne", stratify: bool = True, seed: int = 42) -> list[str]:
    """Stratified (or random) train/val/test split of ``src(doc_id, label, ...)``."""
    out = []
    if stratify:
        out.append(collapse("sp_st", src, "coalesce(label, '__null__')", 3, "Other_Rare", "stratum"))
    else:
        out.append(f"sp_st AS (SELECT *, '__all__' AS stratum FROM {src})")
    out.append(_cut("sp_c1", "sp_st", "stratum", 0.2, "s1", "train", "temp", "s1", seed))
    out.append("sp_temp AS (SELECT * EXCLUDE (s1, _src) FROM sp_c1 WHERE s1 = 'temp')" if stratify else
               "sp_temp AS (SELECT * EXCLUDE (s1) FROM sp_c1 WHERE s1 = 'temp')")
    if stratify:
        out.append(collapse("sp_st2", "sp_temp", "stratum", 2, "Other_Rare_Temp", "stratum2"))
    else:
        out.append("sp_st2 AS (SELECT *, '__all__' AS stratum2, NULL AS _src FROM sp_temp)")
    out.append(_cut("sp_c2", "sp_st2", "stratum2", 0.5, "s2", "val", "test", "split", seed))
    out.append(f"{name} AS (SELECT doc_id, label, stratum, 'train' AS split FROM sp_c1 WHERE s1 = 'train' "
               f"UNION ALL SELECT doc_id, label, stratum, split FROM sp_c2)")
    return out


def presplit(name: str, src: str, key: str, seed: int = 42) -> str:
    b = f"({hash_draw_sql(seed, 'presplit', '@' + key)} % 10)"
    return (f"{name} AS (SELECT *, CASE WHEN {b} = 8 THEN 'val' WHEN {b} = 9 THEN 'test' ELSE 'train' END AS split "
            f"FROM {src})")


def prepared(label: str = "lang") -> list[str]:
    """docs -> non-empty -> split -> long tokens -> lemmas: CTE ``tll(doc_id, label, split, pos, token)``
    plus ``pd(doc_id, label, split, tokens)``."""
    return [docs("docs", label), clean_arrays(),
            "ne_t AS (SELECT doc_id, label, tokens FROM ct WHERE len(tokens) > 0)",
            "ne AS (SELECT doc_id, label FROM ne_t)",
            *splits(),
            "pd AS (SELECT n.doc_id, n.label, s.split, n.tokens FROM ne_t n JOIN splits s ON n.doc_id = s.doc_id)",
            "tl AS (SELECT doc_id, label, split, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM pd)",
            lexicon(), lemma_map(),
            "tll AS (SELECT t.doc_id, t.label, t.split, t.pos, coalesce(m.lemma, t.token) AS token "
            "FROM tl t LEFT JOIN lm m ON t.token = m.token)"]


def prepared_conversations() -> list[str]:
    """Short-text corpus, pre-split by conversation."""
    return [conv_docs("cdocs"), clean_arrays("ct", "cdocs"),
            "ne_t AS (SELECT c.doc_id, c.conv_id, c.label, ct.tokens FROM cdocs c JOIN ct ON c.doc_id = ct.doc_id WHERE len(ct.tokens) > 0)",
            presplit("pd0", "ne_t", "conv_id"),
            "pd AS (SELECT doc_id, label, split, tokens FROM pd0)",
            "tl AS (SELECT doc_id, label, split, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM pd)",
            lexicon(), lemma_map(),
            "tll AS (SELECT t.doc_id, t.label, t.split, t.pos, coalesce(m.lemma, t.token) AS token "
            "FROM tl t LEFT JOIN lm m ON t.token = m.token)"]


def vocab(name: str = "voc", src: str = "tll") -> str:
    return (f"{name} AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id "
            f"FROM (SELECT DISTINCT token FROM {src} WHERE split = 'train' AND length(token) >= 2))")


def bow(name: str = "bow", src: str = "tll", voc: str = "voc") -> str:
    return (f"{name} AS (SELECT t.doc_id, t.split, t.label, v.token_id, CAST(count(*) AS INTEGER) AS cnt "
            f"FROM {src} t JOIN {voc} v ON t.token = v.token GROUP BY t.doc_id, t.split, t.label, v.token_id)")


def label_map(name: str = "lmap", src: str = "pd") -> str:
    return (f"{name} AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label "
            f"FROM (SELECT DISTINCT label FROM {src} WHERE split = 'train' AND label IS NOT NULL))")


# ----------------------------------------------------------------- balancing

def index_rows(name: str, src: str, seed: int = 42) -> str:
    return (f"{name} AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY "
            f"{hash_key_sql(seed, 'order', '@doc_id')}, doc_id) AS idx FROM {src})")


def targets(name: str, src: str) -> str:
    return (f"{name} AS (SELECT label, n, target, deficit, CAST(base + coalesce(sum(deficit) OVER "
            f"(ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" "
            f"FROM (SELECT label, n, max(n) OVER () AS target, max(n) OVER () - n AS deficit, "
            f"max(mk) OVER () + 1 AS base FROM (SELECT label, CAST(count(*) AS BIGINT) AS n, max(doc_id) AS mk "
            f"FROM {src} GROUP BY label)))")


def draws(name: str, tg: str) -> str:
    return (f"{name} AS (SELECT label, n, \"offset\", unnest(range(1, deficit + 1)) AS j FROM {tg} WHERE deficit > 0)")


def ros(name: str, src: str, seed: int = 42) -> list[str]:
    return [index_rows(f"{name}_i", src, seed), targets(f"{name}_t", src), draws(f"{name}_d", f"{name}_t"),
            f"{name} AS (SELECT doc_id AS out_id, doc_id, label, false AS is_copy FROM {src} UNION ALL "
            f"SELECT d.\"offset\" + d.j - 1 AS out_id, i.doc_id, d.label, true AS is_copy FROM {name}_d d "
            f"JOIN {name}_i i ON i.label = d.label AND i.idx = 1 + {hash_draw_sql(seed, '@d.label', '@d.j')} % d.n)"]


def smote_draws(name: str, src: str, k: str, seed: int = 42) -> list[str]:
    r = f"({hash_draw_sql(seed, '@label', '@j')} % (n * {k}))"
    from quill.functions.hashing import hash_unit_sql
    return [index_rows(f"{name}_i", src, seed), targets(f"{name}_t", src), draws(f"{name}_d", f"{name}_t"),
            f"{name}_r AS (SELECT *, {r} AS r, {hash_unit_sql(seed + 1, '@label', '@j')} AS gap FROM {name}_d)",
            f"{name} AS (SELECT d.\"offset\" + d.j - 1 AS out_id, d.label, i.doc_id AS base_id, "
            f"CAST(d.r % {k} + 1 AS INTEGER) AS nn_rank, d.gap FROM {name}_r d JOIN {name}_i i "
            f"ON i.label = d.label AND i.idx = d.r // {k} + 1)"]


def smote_k(src: str, k_max: int = 5) -> str:
    return f"(SELECT least({k_max}, min(n) - 1) FROM (SELECT count(*) AS n FROM {src} GROUP BY label))"


def emb_points(name: str = "pts") -> str:
    return (f"{name} AS (SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(embedding AS DOUBLE[]) AS f, "
            f"CAST(label AS VARCHAR) AS label FROM embeddings)")


def knn_dense(name: str, pts: str, queries: str, k: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS INTEGER) AS rank "
            f"FROM (SELECT q.doc_id AS query_id, r.doc_id AS neighbor_id, "
            f"list_sum(list_transform(range(1, len(q.f) + 1), lambda i: (q.f[i] - r.f[i]) * (q.f[i] - r.f[i]))) AS dist "
            f"FROM {queries} qq JOIN {pts} q ON q.doc_id = qq.doc_id JOIN {pts} r ON r.label = q.label AND r.doc_id <> q.doc_id)) "
            f"WHERE rank <= {k})")


def smote_bow(docs_src: str = "tdocs", bow_src: str = "tbow", seed: int = 42) -> list[str]:
    """Exact brute-force SMOTE on integer counts (oracle form)."""
    k = smote_k(docs_src)
    return [*smote_draws("sd", docs_src, k, seed),
            "bases AS (SELECT DISTINCT base_id, label FROM sd)",
            f"sq AS (SELECT d.doc_id, CAST(coalesce(sum(b.cnt * b.cnt), 0) AS DOUBLE) AS s FROM {docs_src} d "
            f"LEFT JOIN {bow_src} b ON b.doc_id = d.doc_id GROUP BY d.doc_id)",
            f"pairs AS (SELECT bs.base_id AS q, t.doc_id AS r FROM bases bs JOIN {docs_src} t "
            f"ON t.label = bs.label AND t.doc_id <> bs.base_id)",
            f"dots AS (SELECT x.doc_id AS q, y.doc_id AS r, CAST(sum(x.cnt * y.cnt) AS DOUBLE) AS dot "
            f"FROM {bow_src} x JOIN bases bs ON x.doc_id = bs.base_id JOIN {docs_src} ty ON ty.label = bs.label "
            f"JOIN {bow_src} y ON y.doc_id = ty.doc_id AND y.token_id = x.token_id WHERE y.doc_id <> x.doc_id GROUP BY 1, 2)",
            "dist AS (SELECT p.q, p.r, s1.s + s2.s - 2 * coalesce(d.dot, 0) AS dist FROM pairs p "
            "JOIN sq s1 ON s1.doc_id = p.q JOIN sq s2 ON s2.doc_id = p.r LEFT JOIN dots d ON d.q = p.q AND d.r = p.r)",
            f"nn AS (SELECT * FROM (SELECT q AS query_id, r AS neighbor_id, row_number() OVER "
            f"(PARTITION BY q ORDER BY dist, r) AS rank FROM dist) WHERE rank <= {k})",
            "sm AS (SELECT d.out_id, d.label, d.base_id, n.neighbor_id, d.gap FROM sd d JOIN nn n "
            "ON n.query_id = d.base_id AND n.rank = d.nn_rank)",
            f"sa AS (SELECT m.out_id, m.label, m.gap, b.token_id, b.cnt AS a FROM sm m JOIN {bow_src} b ON b.doc_id = m.base_id)",
            f"sb AS (SELECT m.out_id, m.label, m.gap, b.token_id, b.cnt AS b FROM sm m JOIN {bow_src} b ON b.doc_id = m.neighbor_id)",
            "syn AS (SELECT coalesce(sa.out_id, sb.out_id) AS out_id, coalesce(sa.label, sb.label) AS label, "
            "coalesce(sa.token_id, sb.token_id) AS token_id, "
            "CAST(trunc(CAST(coalesce(sa.a, 0) AS DOUBLE) + coalesce(sa.gap, sb.gap) * "
            "(CAST(coalesce(sb.b, 0) AS DOUBLE) - CAST(coalesce(sa.a, 0) AS DOUBLE))) AS INTEGER) AS cnt "
            "FROM sa FULL OUTER JOIN sb ON sa.out_id = sb.out_id AND sa.token_id = sb.token_id)"]


# ----------------------------------------------------------------- sub-word sequences

def wordpiece(src: str = "tll") -> list[str]:
    """Piece vocabulary ``wpv(piece, id)`` and word encodings ``wp_enc(token, piece_ids)``;
    needs ``WITH RECURSIVE``."""
    from quill.operators.wordpiece import MAX_WORD_CHARS, MIN_WORD_DOCS, SPECIALS, strip_accents_sql
    spec = " UNION ALL ".join(f"SELECT '{p}' AS piece, {i} AS id" for i, p in enumerate(SPECIALS))
    piece = "CASE WHEN x.s = 0 THEN substr(x.w, 1, x.l) ELSE '##' || substr(x.w, x.s + 1, x.l) END"
    return [
        f"wp_tr AS (SELECT doc_id, {strip_accents_sql('token')} AS w FROM {src} WHERE split = 'train')",
        "wp_ch AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(w, '')) AS c FROM wp_tr) WHERE length(c) = 1)",
        f"wp_top AS (SELECT w AS piece FROM wp_tr GROUP BY w HAVING count(DISTINCT doc_id) >= {MIN_WORD_DOCS})",
        "wp_p AS (SELECT c AS piece FROM wp_ch UNION SELECT '##' || c FROM wp_ch UNION SELECT piece FROM wp_top)",
        f"wpv AS ({spec} UNION ALL SELECT piece, CAST(row_number() OVER (ORDER BY piece) + {len(SPECIALS) - 1} AS INTEGER) FROM wp_p)",
        "wp_ml AS (SELECT max(CASE WHEN piece LIKE '##%' THEN length(piece) - 2 ELSE length(piece) END) AS ml "
        "FROM wpv WHERE id >= 4)",
        f"wp_w AS (SELECT DISTINCT token, {strip_accents_sql('token')} AS w FROM {src})",
        f"wp_s AS (SELECT token, w, unnest(range(0, length(w))) AS s FROM wp_w WHERE length(w) <= {MAX_WORD_CHARS})",
        "wp_sub AS (SELECT token, w, s, unnest(range(1, least((SELECT ml FROM wp_ml), length(w) - s) + 1)) AS l FROM wp_s)",
        f"wp_m AS (SELECT x.token, x.s, max(x.l) AS l FROM wp_sub x JOIN wpv v ON v.piece = {piece} GROUP BY x.token, x.s)",
        f"wp_mi AS (SELECT x.token, x.s, x.l, v.id FROM (SELECT m.token, m.s, m.l, w.w FROM wp_m m JOIN wp_w w ON w.token = m.token) x "
        f"JOIN wpv v ON v.piece = {piece})",
        "walk AS (SELECT token, s + l AS nxt, [id] AS ids FROM wp_mi WHERE s = 0 "
        "UNION ALL SELECT w.token, m.s + m.l, list_append(w.ids, m.id) FROM walk w JOIN wp_mi m ON m.token = w.token AND m.s = w.nxt)",
        "wp_enc AS (SELECT w.token, coalesce(k.ids, [1]) AS piece_ids FROM wp_w w LEFT JOIN "
        "(SELECT walk.token, walk.ids FROM walk JOIN wp_w x ON x.token = walk.token WHERE walk.nxt = length(x.w)) k ON k.token = w.token)",
    ]


def sequences(src: str = "tll", max_len: int = 128) -> list[str]:
    return [
        f"seq0 AS (SELECT t.doc_id, t.split, t.label, flatten(list(e.piece_ids ORDER BY t.pos)) AS ids "
        f"FROM {src} t JOIN wp_enc e ON e.token = t.token GROUP BY t.doc_id, t.split, t.label)",
        f"seq1 AS (SELECT doc_id, split, label, list_concat([2], ids[1:{max_len - 2}], [3]) AS x FROM seq0)",
        f"seq AS (SELECT doc_id, split, label, CAST(len(x) AS BIGINT) AS n_real, "
        f"array_to_string(list_concat(x, list_transform(range({max_len} - len(x)), lambda i: 0)), ' ') AS input_ids, "
        f"array_to_string(list_concat(list_transform(range(len(x)), lambda i: 1), "
        f"list_transform(range({max_len} - len(x)), lambda i: 0)), ' ') AS attention_mask FROM seq1)",
    ]


# ----------------------------------------------------------------- classifier on pooled vectors

def classifier() -> list[str]:
    """Embeddings split by label, label map, centroid head, test logits and predictions."""
    return [emb_points("pts"), *splits("esplit", "pts"),
            "ep AS (SELECT p.doc_id, p.label, p.f, s.split FROM pts p JOIN esplit s ON s.doc_id = p.doc_id)",
            "lmap AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label "
            "FROM (SELECT DISTINCT label FROM ep WHERE split = 'train'))",
            "cx AS (SELECT m.label_id, unnest(e.f) AS v, generate_subscripts(e.f, 1) AS dim FROM ep e "
            "JOIN lmap m ON m.label = e.label WHERE e.split = 'train')",
            "cw AS (SELECT label_id, list(m ORDER BY dim) AS w FROM (SELECT label_id, dim, avg(v) AS m FROM cx GROUP BY label_id, dim) GROUP BY label_id)",
            "head AS (SELECT label_id, w, -0.5 * list_sum(list_transform(w, lambda x: x * x)) AS b FROM cw)",
            "tst AS (SELECT e.doc_id, m.label_id, e.f FROM ep e JOIN lmap m ON m.label = e.label WHERE e.split = 'test')",
            "lg AS (SELECT t.doc_id, t.label_id AS true_id, h.label_id AS class_id, "
            "list_sum(list_transform(range(1, len(t.f) + 1), lambda i: t.f[i] * h.w[i])) + h.b AS logit FROM tst t, head h)",
            "pr AS (SELECT doc_id, true_id AS label_id, class_id AS pred_id FROM (SELECT *, row_number() OVER "
            "(PARTITION BY doc_id ORDER BY logit DESC, class_id) AS rk FROM lg) WHERE rk = 1)",
            "tp AS (SELECT label_id, count(*) AS tp FROM pr WHERE pred_id = label_id GROUP BY label_id)",
            "sup AS (SELECT label_id, count(*) AS support FROM pr GROUP BY label_id)",
            "np AS (SELECT pred_id AS label_id, count(*) AS npred FROM pr GROUP BY pred_id)",
            "cls AS (SELECT label_id FROM lmap UNION SELECT label_id FROM sup UNION SELECT label_id FROM np)",
            "sc0 AS (SELECT c.label_id, coalesce(tp.tp, 0) AS tp, coalesce(sup.support, 0) AS support, coalesce(np.npred, 0) AS npred "
            "FROM cls c LEFT JOIN tp USING (label_id) LEFT JOIN sup USING (label_id) LEFT JOIN np USING (label_id))",
            "sc1 AS (SELECT label_id, tp, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision, "
            "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM sc0)",
            "sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM sc1)"]


def full_batch_epoch(lr: float) -> list[str]:
    """One AdamW step from zero weights on all train rows at once: the first
    step moves each weight by lr against the sign of its gradient (which the
    small constant in the divisor softens)."""
    return ["fb_t AS (SELECT e.doc_id, m.label_id, list_prepend(1.0::DOUBLE, e.f) AS f FROM ep e JOIN lmap m ON m.label = e.label WHERE e.split = 'train')",
            "fb_n AS (SELECT (SELECT count(*) FROM fb_t) AS n, (SELECT count(*) FROM lmap) AS c)",
            "fb_x AS (SELECT label_id, unnest(f) AS v, generate_subscripts(f, 1) - 2 AS dim FROM fb_t)",
            "fb_s AS (SELECT dim, sum(v) AS s FROM fb_x GROUP BY dim)",
            "fb_own AS (SELECT label_id, dim, sum(v) AS s FROM fb_x GROUP BY label_id, dim)",
            "fb_g AS (SELECT m.label_id, a.dim, (a.s / c - coalesce(o.s, 0)) / n AS g FROM lmap m CROSS JOIN fb_s a CROSS JOIN fb_n "
            "LEFT JOIN fb_own o ON o.label_id = m.label_id AND o.dim = a.dim)",
            f"fb_w AS (SELECT label_id, dim, -{lr} * g / (abs(g) + 1e-8) AS weight FROM fb_g)",
            "fb_h AS (SELECT label_id, list(weight ORDER BY dim) AS w FROM fb_w GROUP BY label_id)",
            "fb_v AS (SELECT e.doc_id, m.label_id, list_prepend(1.0::DOUBLE, e.f) AS f FROM ep e JOIN lmap m ON m.label = e.label WHERE e.split = 'val')",
            "fb_p AS (SELECT v.doc_id, v.label_id, h.label_id AS pred_id, row_number() OVER (PARTITION BY v.doc_id "
            "ORDER BY list_sum(list_transform(range(1, len(v.f) + 1), lambda i: v.f[i] * h.w[i])) DESC, h.label_id) AS rk FROM fb_v v, fb_h h)",
            "fb_log AS (SELECT ln(c) AS loss, (SELECT avg(CASE WHEN label_id = 0 THEN 1.0 ELSE 0.0 END) FROM fb_t) AS train_accuracy, "
            "(SELECT avg(CASE WHEN label_id = pred_id THEN 1.0 ELSE 0.0 END) FROM fb_p WHERE rk = 1) AS val_accuracy FROM fb_n)"]


# ----------------------------------------------------------------- topic model

def topic_params(H: int, K: int, seed: int = 42, voc: str = "voc") -> list[str]:
    """Hash-initialised parameters: enc(r, w[H]), encb(w[H]), mu/lv(r, w[K]), mub/lvb(w[K]),
    dec(r, w[K]), decb(r, b)."""
    from quill.functions.hashing import hash_unit_sql

    def vals(layer, cols, fan_in, row="r"):
        b2 = f"(CAST(2.0 AS DOUBLE) * (CAST(1.0 AS DOUBLE) / sqrt(CAST({fan_in} AS DOUBLE))))"
        u = hash_unit_sql(seed, layer, f"@(CAST({row} AS BIGINT) * {cols} + c)")
        return f"list_transform(range({cols}), lambda c: ({u} - 0.5) * {b2})"
    b2k = f"(CAST(2.0 AS DOUBLE) * (CAST(1.0 AS DOUBLE) / sqrt(CAST({K} AS DOUBLE))))"
    return [
        f"tp_V AS (SELECT count(*) AS V FROM {voc})",
        f"tp_enc AS (SELECT token_id AS r, {vals('enc', H, 'tv.V')} AS w FROM {voc}, tp_V tv)",
        f"tp_encb AS (SELECT {vals('enc_b', H, 'tv.V', '0')} AS w FROM tp_V tv)",
        f"tp_mu AS (SELECT r, {vals('mu', K, H)} AS w FROM range({H}) t(r))",
        f"tp_mub AS (SELECT {vals('mu_b', K, H, '0')} AS w)",
        f"tp_dec AS (SELECT token_id AS r, {vals('dec', K, K)} AS w FROM {voc})",
        f"tp_decb AS (SELECT token_id AS r, ({hash_unit_sql(seed, 'dec_b', '@token_id')} - 0.5) * {b2k} AS b FROM {voc})",
        f"tp_lv AS (SELECT r, {vals('lv', K, H)} AS w FROM range({H}) t(r))",
        f"tp_lvb AS (SELECT {vals('lv_b', K, H, '0')} AS w)",
    ]


def topic_forward(H: int, K: int, bow_src: str = "vb") -> list[str]:
    """Evaluation forward pass (z = mu) for ``bow_src(doc_id, token_id, cnt)``:
    mu/logvar per document, log-probabilities of the document's tokens."""
    return [
        f"tf_a AS (SELECT doc_id, j, sum(cnt * w[j + 1]) AS s FROM (SELECT b.doc_id, b.cnt, e.w, unnest(range({H})) AS j "
        f"FROM {bow_src} b JOIN tp_enc e ON e.r = b.token_id) GROUP BY doc_id, j)",
        "tf_h AS (SELECT a.doc_id, a.j, greatest(a.s + b.w[a.j + 1], 0.0) AS h FROM tf_a a, tp_encb b)",
        f"tf_mu AS (SELECT h.doc_id, k, sum(h.h * m.w[k + 1]) AS s FROM (SELECT *, unnest(range({K})) AS k FROM tf_h) h "
        f"JOIN tp_mu m ON m.r = h.j GROUP BY h.doc_id, k)",
        f"tf_lv AS (SELECT h.doc_id, k, sum(h.h * m.w[k + 1]) AS s FROM (SELECT *, unnest(range({K})) AS k FROM tf_h) h "
        f"JOIN tp_lv m ON m.r = h.j GROUP BY h.doc_id, k)",
        "tf_z AS (SELECT m.doc_id, list(m.s + b.w[m.k + 1] ORDER BY m.k) AS mu FROM tf_mu m, tp_mub b GROUP BY m.doc_id)",
        "tf_v AS (SELECT m.doc_id, list(m.s + b.w[m.k + 1] ORDER BY m.k) AS lv FROM tf_lv m, tp_lvb b GROUP BY m.doc_id)",
        # logits are summed as they come, none is kept; weights are at most 1 / sqrt(K), so exp cannot overflow
        "tf_lse AS (SELECT z.doc_id, ln(sum(exp(list_inner_product(z.mu, d.w) + db.b))) AS lse FROM tf_z z, tp_dec d "
        "JOIN tp_decb db ON db.r = d.r GROUP BY z.doc_id)",
        f"tf_lp AS (SELECT b.doc_id, b.token_id, b.cnt, list_inner_product(z.mu, d.w) + db.b - s.lse AS logp FROM {bow_src} b "
        f"JOIN tf_z z ON z.doc_id = b.doc_id JOIN tp_dec d ON d.r = b.token_id JOIN tp_decb db ON db.r = b.token_id "
        f"JOIN tf_lse s ON s.doc_id = b.doc_id)",
    ]


def top_words(n: int = 10, n_topics: int | None = None) -> str:
    lim = f"WHERE topic < {n_topics}" if n_topics is not None else ""
    return (f"tw AS (SELECT t.topic, CAST(t.rank AS INTEGER) AS rank, t.token_id, v.token FROM ("
            f"SELECT topic, token_id, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, token_id DESC) AS rank "
            f"FROM (SELECT CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS topic, CAST(r AS INTEGER) AS token_id, unnest(w) AS weight FROM tp_dec) {lim}"
            f") t JOIN voc v ON v.token_id = t.token_id WHERE t.rank <= {n})")


def coherence(texts: str = "ctx", words: str = "tw", width: int = 110) -> list[str]:
    return [
        f"ch_len AS (SELECT doc_id, max(pos) + 1 AS L FROM {texts} GROUP BY doc_id)",
        f"ch_occ AS (SELECT doc_id, token, pos FROM {texts} WHERE token IN (SELECT token FROM {words}))",
        f"ch_n AS (SELECT CAST(sum(greatest(L - {width - 1}, 1)) AS BIGINT) AS n FROM ch_len WHERE doc_id IN (SELECT doc_id FROM ch_occ))",
        f"ch_o AS (SELECT o.doc_id, o.token, greatest(o.pos - {width - 1}, 0) AS lo, least(o.pos, greatest(l.L - {width}, 0)) AS hi "
        f"FROM ch_occ o JOIN ch_len l ON l.doc_id = o.doc_id)",
        "ch_o2 AS (SELECT *, CASE WHEN pm IS NULL OR lo > pm THEN 1 ELSE 0 END AS nw_ FROM (SELECT *, max(hi) OVER "
        "(PARTITION BY doc_id, token ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ch_o))",
        "ch_o3 AS (SELECT *, sum(nw_) OVER (PARTITION BY doc_id, token ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM ch_o2)",
        "ch_isl AS (SELECT doc_id, token, min(lo) AS lo, max(hi) AS hi FROM ch_o3 GROUP BY doc_id, token, isl)",
        "ch_wc AS (SELECT token, sum(hi - lo + 1) AS c FROM ch_isl GROUP BY token)",
        f"ch_t AS (SELECT DISTINCT w.topic, w.token, c.c FROM {words} w JOIN ch_wc c ON c.token = w.token)",
        "ch_p AS (SELECT a.topic, a.token AS wi, b.token AS wj, a.c AS c_wi, b.c AS c_wj FROM ch_t a JOIN ch_t b ON a.topic = b.topic)",
        "ch_ov AS (SELECT a.token AS wi, b.token AS wj, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS c_ij "
        "FROM ch_isl a JOIN ch_isl b ON a.doc_id = b.doc_id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2)",
        "ch_np AS (SELECT p.topic, p.wi, p.wj, CASE WHEN ov.c_ij = n.n THEN 1.0 ELSE "
        "ln((coalesce(ov.c_ij, 0) / n.n + 1e-12) / ((p.c_wi / n.n) * (p.c_wj / n.n))) / (-ln(coalesce(ov.c_ij, 0) / n.n + 1e-12)) END AS npmi "
        "FROM ch_p p LEFT JOIN ch_ov ov ON ov.wi = p.wi AND ov.wj = p.wj, ch_n n)",
        "ch_vs AS (SELECT topic, wj, sum(npmi) AS V FROM ch_np GROUP BY topic, wj)",
        "ch_cs AS (SELECT x.topic, x.wi, sum(x.npmi * v.V) / (sqrt(sum(x.npmi * x.npmi)) * sqrt(sum(v.V * v.V))) AS cos "
        "FROM ch_np x JOIN ch_vs v ON v.topic = x.topic AND v.wj = x.wj GROUP BY x.topic, x.wi)",
        "ch_coh AS (SELECT topic, avg(cos) AS coherence FROM ch_cs GROUP BY topic)",
    ]
