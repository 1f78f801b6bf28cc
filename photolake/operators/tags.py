"""Tags: synonym expansion, classification, balance and related photos.

The synonym dictionary is a fixed list of about a hundred words, so it travels as a literal map inside
the expression: expansion and classification are maps over posts, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from photolake.functions.columns import h32
from photolake.functions.fixed import NSFW_TAGS, PERSON_TAGS, TAG_SYNONYMS
from photolake.operators.search import photo_rows


def expansions() -> dict[str, list[str]]:
    """Lower-case word -> every word of each dictionary entry that contains it."""
    table: dict[str, set[str]] = {}
    for key, words in TAG_SYNONYMS.items():
        for word in [key, *words]:
            table.setdefault(word.lower(), set()).update([key, *words])
    return {word: sorted(found) for word, found in table.items()}


def _lookup(table: dict[str, list[str]]) -> Column:
    """The table as a constant map expression."""
    def text(word: str) -> str:
        return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"

    entries = (f"{text(word)}, array({', '.join(map(text, found))})" for word, found in table.items())
    return F.expr(f"map({', '.join(entries)})")


def expand_tag(tag: Column) -> Column:
    """All words the tag stands for; null for a tag outside the dictionary."""
    return F.try_element_at(_lookup(expansions()), F.lower(tag))


def translate_tags(posts: DataFrame) -> DataFrame:
    """(post_id, tag, expanded): each tag with the key and synonyms of every entry it belongs to."""
    return (posts.select("post_id", F.explode("tags").alias("tag"))
            .select("post_id", "tag", F.explode(expand_tag(F.col("tag"))).alias("expanded")))


def _matched(vocabulary: list[str]) -> Column:
    """The vocabulary words among the post's expanded tags, each once."""
    hits = {w: [v for v in vocabulary if v in {f.lower() for f in found}] for w, found in expansions().items()}
    table = _lookup({w: v for w, v in hits.items() if v})
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(
        F.transform("tags", lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), none)))))


def classify_by_tags(posts: DataFrame) -> DataFrame:
    """Person and safety flags per post, with matched vocabulary words and their share."""
    person = F.coalesce(_matched(PERSON_TAGS), F.array().cast("array<string>"))
    return posts.select("post_id", person.alias("matched_tags"),
                        (F.size(F.coalesce(_matched(NSFW_TAGS), F.array().cast("array<string>"))) > 0)
                        .alias("is_nsfw")).select(
        "post_id", (F.size("matched_tags") > 0).alias("is_person"), "is_nsfw", "matched_tags",
        (F.size("matched_tags") / F.lit(float(len(PERSON_TAGS)))).alias("confidence"))


def lower_tags(posts: DataFrame) -> DataFrame:
    return posts.withColumn("tags", F.array_distinct(F.transform("tags", lambda t: F.lower(t))))


def tag_counts(posts: DataFrame) -> DataFrame:
    """Posts and images per lower-case tag; counts are partially summed before the shuffle."""
    return (lower_tags(posts).select(F.explode("tags").alias("tag"), F.size("photos").alias("n"))
            .groupBy("tag").agg(F.count("*").alias("n_posts"), F.sum("n").alias("n_images")))


def counted_tags(posts: DataFrame) -> DataFrame:
    """(post_id, tag, n_posts): each post's tags with their global counts.

    The counts side has one row per tag, so a hot tag only widens the posts side, which adaptive
    skew handling can split.
    """
    return (lower_tags(posts).select("post_id", F.explode("tags").alias("tag"))
            .join(tag_counts(posts).select("tag", "n_posts"), "tag"))


def tag_quota_sample(posts: DataFrame, limit: int = 10) -> DataFrame:
    """At most ``limit`` posts per tag, each post under its rarest tag (ties by name).

    The rank filter is applied per task before the exchange, so a hot tag moves few rows.
    """
    rarest = (counted_tags(posts).groupBy("post_id")
              .agg(F.min(F.struct("n_posts", "tag")).alias("m")).select("post_id", F.col("m.tag").alias("tag")))
    order = W.partitionBy("tag").orderBy(h32(F.col("post_id")), "post_id")
    return rarest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def balanced_tags(posts: DataFrame) -> DataFrame:
    """Each post's tags that have its smallest count."""
    low = F.min("n_posts").over(W.partitionBy("post_id"))
    return counted_tags(posts).withColumn("low", low).where("n_posts = low").select("post_id", "tag", "n_posts")


def sampled_tag(tags: Column, seed: Column) -> Column:
    """A pseudo-random tag: the one with the smallest hash of seed and tag. No shuffle."""
    return F.array_min(F.transform(tags, lambda t: F.struct(
        h32(F.concat(seed.cast("string"), t)).alias("k"), t.alias("tag"))))["tag"]


def sample_tag(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", sampled_tag(F.col("tags"), F.col("post_id")).alias("tag")).where("tag IS NOT NULL")


def tag_search(posts: DataFrame, tag: str) -> DataFrame:
    """Photos having the tag or one of its synonyms."""
    words = {w.lower() for w in expansions().get(tag.lower(), [])} | {tag.lower()}
    hit = F.exists("tags", lambda t: F.lower(t).isin(sorted(words)))
    return photo_rows(posts.where(hit))


def related_pool(posts: DataFrame, count: int = 3) -> DataFrame:
    """(tag, pool): the photos of each tag that any post may get as related ones, at most 2 * ``count``.

    Only the first 2 * count photos of each tag can be needed, when no post supplies more than
    ``count`` of them: at most ``count`` belong to the asking post. Both ranks are cut per task before
    the exchange, and the few survivors travel as one array per tag, so a hot tag emits no pairs.
    """
    photo = photo_rows(posts.select("post_id", "tags", "photos"))
    per_tag = photo.select("post_id", "url", h32(F.col("url")).alias("k"), F.explode("tags").alias("tag"))
    order = [F.col("k"), F.col("url")]
    own = F.row_number().over(W.partitionBy("tag", "post_id").orderBy(*order))
    top = F.row_number().over(W.partitionBy("tag").orderBy(*order, "post_id"))
    return (per_tag.withColumn("own", own).where(F.col("own") <= count)
            .withColumn("top", top).where(F.col("top") <= 2 * count)
            .groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("k", "url", "post_id"))).alias("pool")))


def related_from(asking: DataFrame, pool: DataFrame, count: int = 3) -> DataFrame:
    """For one sampled tag per asking post: up to ``count`` photos of other posts out of that tag's pool."""
    others = F.slice(F.filter("pool", lambda c: c["post_id"] != F.col("post_id")), 1, count)
    return (sample_tag(asking).join(pool, "tag").select("post_id", "tag", F.posexplode(others).alias("pos", "c"))
            .select("post_id", "tag", (F.col("pos") + 1).alias("rank"), F.col("c.post_id").alias("other_post_id"),
                    F.col("c.url").alias("url")))


def related_images(posts: DataFrame, count: int = 3) -> DataFrame:
    """For one sampled tag per post: up to ``count`` photos of other posts having that tag."""
    return related_from(posts, related_pool(posts, count), count)
