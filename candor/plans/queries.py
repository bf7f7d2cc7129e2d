"""Every operator as a named query over the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.lineage import cut, shared_folder, written
from candor.models.ensemble import (
    BLEND, GRAPH, NLP, EnsembleModel, Training, ensemble_importances, feature_importances, train_ensemble,
)
from candor.models.search import search_graph, search_text
from candor.models.split import stratified_split
from candor.models.tfidf import tfidf_weights
from candor.operators import behavior, centrality, clean, graph, meta, metrics, reports, suspicious, text
from candor.operators.text_similarity import text_similarity
from candor.plans.analysis import analyze_model, analyze_rules, score_batch
from candor.plans.feature_store import FeatureStore
from candor.plans.features import GRAPH_FEATURES, graph_features
from candor.sources.reviews import parse_products, parse_reviews, parse_users
from candor.sources.views import view

Query = Callable[[SparkSession, str], DataFrame]

PLACES = 6
NUDGE = 1e-9  # moves values that lie exactly between two roundings, so that the last bit of a sum does not decide


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero), so that summation order does not show."""
    return df.select(*[(F.round(F.col(c) + NUDGE, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on(name: str, op: Callable[..., DataFrame], *, users: bool = False, products: bool = False, drop=()) -> Query:
    """Apply ``op`` to a view, with metadata views as further arguments."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = [view(spark, sf_dir, name)]
        if users:
            args.append(view(spark, sf_dir, "users_v"))
        if products:
            args.append(view(spark, sf_dir, "products_v"))
        return rounded(op(*args).drop(*drop))

    return run


def _edges_of(name: str, op: Callable[..., DataFrame], *columns: str) -> Query:
    """Apply ``op`` to the edges of a view, written out with the ``columns`` it reads (all by default)."""
    return _on(name, lambda df: op(written(graph.review_edges(df).select(*(columns or "*")), "edges")))


def _as_text(df: DataFrame) -> DataFrame:
    """The table as a CSV scan would deliver it."""
    casts = {"timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*[casts.get(t, lambda c: F.col(c).cast("string"))(c).alias(c) for c, t in df.dtypes])


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _scan(name: str, parse: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(name, lambda df: _ntz(parse(_as_text(df))))


TEXT_DROP = ("review_text", "lang", "verified_purchase")
REVIEW = "review_id"
PAIR = ("user_id", "product_id")


def _by_language(df: DataFrame) -> DataFrame:
    """One user per language, so that copies of a text meet as duplicates."""
    return df.withColumn("user_id", F.col("lang"))


def _dirty(df: DataFrame) -> DataFrame:
    """Text ratings, some unreadable, some missing, derived from the rows themselves."""
    return df.withColumn(
        "rating",
        F.when(F.col("review_id") % 11 == 0, F.lit("abc")).when(F.col("review_id") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("rating").cast("string")),
    )


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat(x["ngram"], F.lit(":"), x["count"].cast("string"))), "|")


def lemma_table(df: DataFrame) -> DataFrame:
    """A (form, lemma) table from the corpus: a word whose singular also occurs is its plural form."""
    words = text.tokenize(df, out="_w").select(F.explode("_w").alias("form")).distinct()
    singular = words.select(F.col("form").alias("lemma"), F.concat("form", F.lit("s")).alias("form"))
    return words.join(singular, "form").select("form", "lemma")


def _lemmas(df: DataFrame) -> DataFrame:
    out = text.lemmatize(text.tokenize(df), lemma_table(df))
    return out.select(REVIEW, F.array_join("lemmas", " ").alias("lemmas"))


def _ngrams(df: DataFrame) -> DataFrame:
    out = text.tokenize(df)
    two, three = tx.ngrams(F.col("tokens"), 2), tx.ngrams(F.col("tokens"), 3)
    return out.select(REVIEW, F.array_join(two, "|").alias("bigrams"), F.array_join(three, "|").alias("trigrams"))


def _top_ngrams(df: DataFrame) -> DataFrame:
    return text.top_ngrams(df).select(
        REVIEW, _joined("top_bigrams").alias("top_bigrams"), _joined("top_trigrams").alias("top_trigrams")
    )


def _review_words(df: DataFrame) -> DataFrame:
    return text.review_word_frequencies(df).select(REVIEW, _joined("top_words").alias("top_words"))


def _burst(key: str) -> Query:
    return _on("reviews_v", lambda df: behavior.burstiness(df, key))


def _highlight(df: DataFrame, op: Callable[..., DataFrame]) -> DataFrame:
    edges = written(graph.review_edges(df), "edges")
    return op(edges, suspicious.suspicious_users(edges))


def _cards(df: DataFrame) -> DataFrame:
    edges = written(graph.review_edges(df), "edges")
    return reports.summary_cards(df, suspicious.suspicious_users(edges), suspicious.suspicious_products(edges))


def _neighbor_degree(df: DataFrame) -> DataFrame:
    return graph.bipartite_degrees(graph.review_edges(df))[0].select("user_id", "user_neighbors_avg_degree")


def _align(df: DataFrame) -> DataFrame:
    rows = meta.metadata_features(df, None, None)
    return clean.align_features(rows, ["rating", "price", "helpful_votes", "label"])


def _text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "text_reviews_v").drop("lang").withColumn("review_id", F.col("review_id").cast("string"))


def _labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_reviews(spark, sf_dir).filter(F.col("verified_purchase").isNotNull())


_trained: dict[tuple[str, str], Training] = {}


def trained(spark: SparkSession, sf_dir: str) -> Training:
    """Train once per application and data set; the model queries share the result."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = train_ensemble(
            _text_reviews(spark, sf_dir), view(spark, sf_dir, "users_v"), view(spark, sf_dir, "products_v"),
        )
    return _trained[key]


def _scored(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(trained(spark, sf_dir).held_out.select(REVIEW, "label", column))

    return run


def _nlp_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the vectors: (review_id, term, weight)."""
    return rounded(tfidf_weights(_text_reviews(spark, sf_dir)))


def _all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph features of all reviews, labelled or not, with metadata and centralities: what the models are trained on."""
    return cut(graph_features(_text_reviews(spark, sf_dir), view(spark, sf_dir, "users_v"), view(spark, sf_dir, "products_v")))


def _grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of both grids."""
    rows = _labelled_text(spark, sf_dir)
    features = _all_features(spark, sf_dir).drop("verified_purchase")
    names = [c for c in GRAPH_FEATURES if c in features.columns]
    labels = clean.label(rows)
    data = cut(features.join(labels.select(REVIEW, "label"), REVIEW))
    texts = cut(labels.select(REVIEW, "review_text", "label"))
    points = search_text(texts).withColumn("forest", F.lit("text"))
    return rounded(points.unionByName(search_graph(data, names).withColumn("forest", F.lit("graph"))))


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all reviews by the saved and reloaded model, next to those of the model itself."""
    model = trained(spark, sf_dir).model
    path = shared_folder(spark, "model")
    model.save(spark, path)
    rows, features = _text_reviews(spark, sf_dir), _all_features(spark, sf_dir)
    original = model.scores(rows, features=features).select(REVIEW, F.col(BLEND).alias("original_probability"))
    return rounded(EnsembleModel.load(spark, path).scores(rows, features=features).join(original, REVIEW))


def _analyze_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text_reviews(spark, sf_dir)
    out = analyze_model(rows, trained(spark, sf_dir).model, view(spark, sf_dir, "users_v"), view(spark, sf_dir, "products_v"))
    return rounded(out.drop("review_text"))


def _new_store(spark: SparkSession, history: DataFrame, **options) -> FeatureStore:
    """A store in a folder of its own."""
    return FeatureStore.create(spark, shared_folder(spark, "features"), history, **options)


def _score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents come in as new reviews, the labelled ones are the history, known to the store only."""
    rows = _text_reviews(spark, sf_dir)
    new = rows.filter(F.col("verified_purchase").isNull())
    store = _new_store(spark, rows.filter(F.col("verified_purchase").isNotNull()))
    metadata = view(spark, sf_dir, "users_v"), view(spark, sf_dir, "products_v")
    return rounded(score_batch(new, store, trained(spark, sf_dir).model, *metadata).drop("review_text"))


#: Reviews from these days on come in as the second and the last batch.
BATCH_DAYS = ("2000-01-01", "2001-07-01")


def _batch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the newest reviews, against a store that took in the older ones in two batches."""
    rows = view(spark, sf_dir, "rings_v")
    second, last = [F.lit(day).cast("timestamp_ntz") for day in BATCH_DAYS]
    store = _new_store(spark, rows.filter(F.col("date") < second), refresh=False)
    store.merge(rows.filter((F.col("date") >= second) & (F.col("date") < last)))
    newest = rows.filter((F.col("date") >= last) | F.col("date").isNull())
    return rounded(store.features(newest, view(spark, sf_dir, "users_v"), view(spark, sf_dir, "products_v"), snapshot=False))


def _train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trained(spark, sf_dir).metrics["classification_report"])


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_importances(spark, trained(spark, sf_dir).model.text))


def _ensemble_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensemble_importances(spark, trained(spark, sf_dir).model))


def _predicted(df: DataFrame) -> DataFrame:
    return metrics.ensemble_score(df, NLP, GRAPH, 0.6).withColumn("predicted", (F.col(BLEND) >= 0.5).cast("int"))


def _rules(df: DataFrame) -> DataFrame:
    return analyze_rules(df)


def queries() -> dict[str, Query]:
    return {
        # scans
        "scan_reviews": _scan("reviews_v", lambda d: clean.coerce_rating(parse_reviews(d))),
        "scan_users": _scan("users_v", parse_users),
        "scan_products": _scan("products_v", parse_products),
        # cleaning, filters, flags
        "clean_dropna": _on("text_reviews_v", clean.drop_incomplete, drop=TEXT_DROP),
        "clean_dedup": _on("text_reviews_v", lambda d: clean.deduplicate(_by_language(d)), drop=TEXT_DROP),
        "clean_rating": _on("text_reviews_v", lambda d: clean.coerce_rating(_dirty(d)), drop=TEXT_DROP),
        "clean_reviews": _on("text_reviews_v", lambda d: clean.clean_reviews(_dirty(_by_language(d))), drop=TEXT_DROP),
        "filter_reviews": _on("reviews_v", lambda d: clean.filter_reviews(d, "suspicious")),
        "filter_reviews_user": _on("reviews_v", lambda d: clean.filter_reviews(d, "user", "u7")),
        "filter_reviews_product": _on("reviews_v", lambda d: clean.filter_reviews(d, "product", "p7")),
        "sample_reviews": _on("reviews_v", clean.fixed_sample),
        "flag_threshold": _on("scores_v", lambda d: clean.threshold_flags(d, score=NLP)),
        "risk_band": _on("scores_v", lambda d: clean.risk_band(d, score=NLP)),
        "align_features": _on("reviews_v", _align),
        "label": _on("reviews_v", lambda d: clean.label(d).select(REVIEW, "label")),
        "stratified_split": _on("reviews_v", lambda d: stratified_split(d).select(REVIEW, "verified_purchase", "split")),
        # metadata joins
        "join_user_meta": _on("reviews_v", meta.join_users, users=True),
        "join_product_meta": _on("reviews_v", meta.join_products, products=True),
        "account_age": _on("reviews_v", meta.account_age, users=True),
        "product_age": _on("reviews_v", meta.product_age, products=True),
        "metadata_features": _on("reviews_v", meta.metadata_features, users=True, products=True),
        # behaviour
        "daily_review_count": _on("reviews_v", behavior.daily_review_count),
        "same_day_counts": _on("reviews_v", behavior.same_day_counts),
        "calendar_parts": _on("events_v", behavior.calendar_parts),
        "user_burstiness": _burst("user_id"),
        "product_burstiness": _burst("product_id"),
        "burst_intervals": _on("events_v", lambda d: behavior.burst_intervals(d, "user_id")),
        "posting_entropy": _on("events_v", behavior.posting_entropy),
        "user_behavior": _on("reviews_v", behavior.user_behavior),
        "product_behavior": _on("reviews_v", behavior.product_behavior),
        "user_verified_ratio": _on("reviews_v", behavior.user_verified_ratio),
        "behavioral_features": _on("rings_v", behavior.behavioral_features, users=True, products=True),
        # reports
        "user_product_metrics": _on("reviews_v", reports.user_product_metrics, users=True),
        "summary_cards": _on("rings_v", _cards),
        "rating_distribution": _on("reviews_v", reports.rating_distribution),
        "verification_status": _on("reviews_v", reports.verification_status),
        "daily_burst_days": _on(
            "reviews_v", lambda d: reports.daily_burst_days(d).withColumn("day", F.col("day").cast("timestamp_ntz"))
        ),
        "flag_summary": _on("rings_v", lambda d: reports.flag_summary(_rules(d))),
        "network_stats": _on("rings_v", lambda d: _highlight(d, reports.network_stats)),
        "network_nodes": _on("rings_v", lambda d: _highlight(d, reports.network_nodes)),
        "network_edges": _on("rings_v", lambda d: _highlight(d, reports.network_edges)),
        "top_suspicious": _on("rings_v", lambda d: reports.top_suspicious(_rules(d))),
        "recent_suspicious": _on("text_reviews_v", reports.recent_suspicious),
        # review graph
        "review_edges": _edges_of("market_v", lambda e: e),
        "graph_degrees": _on("reviews_v", graph.graph_degrees),
        "neighbor_avg_degree": _on("reviews_v", _neighbor_degree),
        "user_pair_similarity": _edges_of("rings_v", suspicious.user_pair_similarity),
        "product_pair_similarity": _edges_of("rings_v", suspicious.product_pair_similarity, *PAIR),
        "user_profile_members": _edges_of("rings_v", suspicious.user_profiles),
        "product_profile_members": _edges_of("rings_v", suspicious.product_profiles, *PAIR),
        "suspicious_users": _edges_of("rings_v", suspicious.suspicious_users),
        "suspicious_products": _edges_of("rings_v", suspicious.suspicious_products),
        "suspicious_user_groups": _edges_of("rings_v", suspicious.suspicious_user_groups),
        "suspicious_product_groups": _edges_of("rings_v", suspicious.suspicious_product_groups, *PAIR),
        "coreview_edges": _edges_of("market_v", graph.coreview_edges, *PAIR),
        "coreview_class_members": _edges_of("market_v", lambda e: graph.coreview_factors(e)[0], *PAIR),
        "coreview_class_products": _edges_of("market_v", lambda e: graph.coreview_factors(e)[1], *PAIR),
        "coreview_strong_links": _edges_of("market_v", lambda e: graph.coreview_factors(e)[2], *PAIR),
        "user_similarity_stats": _edges_of("market_v", graph.user_similarity_stats, *PAIR),
        "user_clustering": _edges_of("market_v", graph.user_clustering, *PAIR),
        "betweenness": _edges_of("market_v", centrality.betweenness_centrality, *PAIR),
        "eigenvector_centrality": _edges_of("market_v", centrality.eigenvector_centrality, *PAIR),
        "graph_features": _on("rings_v", graph_features, users=True, products=True),
        "batch_features": _batch_features,
        "analyze_rules": _on("rings_v", _rules),
        # text
        "basic_text_features": _on("text_reviews_v", text.basic_text_features, drop=TEXT_DROP),
        "clean_text": _on("text_reviews_v", lambda d: text.clean_text(d).select(REVIEW, "clean_text")),
        "tokenize": _on("text_reviews_v", lambda d: text.tokenize(d).select(REVIEW, F.array_join("tokens", " ").alias("tokens"))),
        "ngrams": _on("text_reviews_v", _ngrams),
        "lemma_lookup": _on("text_reviews_v", _lemmas),
        "text_statistics": _on("text_reviews_v", text.text_statistics, drop=TEXT_DROP),
        "top_ngrams": _on("text_reviews_v", _top_ngrams),
        "sentiment_features": _on("text_reviews_v", text.sentiment_features, drop=TEXT_DROP),
        "linguistic_features": _on("text_reviews_v", text.linguistic_features, drop=TEXT_DROP),
        "text_similarity_product": _on("text_reviews_v", lambda d: text_similarity(d, group_col="product_id")),
        "text_similarity_user": _on("text_reviews_v", lambda d: text_similarity(d, group_col="user_id")),
        "text_features": _on("text_reviews_v", text.text_features, drop=TEXT_DROP),
        "word_frequencies": _on("text_reviews_v", text.word_frequencies),
        "review_word_frequencies": _on("text_reviews_v", _review_words),
        "sentiment_mix": _on("text_reviews_v", lambda d: text.sentiment_mix(d).select(REVIEW, "positive_count", "negative_count", "neutral_count")),
        # metrics over given scores
        "ensemble_score": _on("scores_v", lambda d: metrics.ensemble_score(d, NLP, GRAPH, 0.6)),
        "tune_weights": _on("scores_v", lambda d: metrics.tune_weights(d, NLP, GRAPH)),
        "roc_auc": _on("scores_v", lambda d: metrics.roc_auc(d, "label", NLP)),
        "roc_curve": _on("scores_v", lambda d: metrics.roc_curve(d, "label", NLP)),
        "pr_curve": _on("scores_v", lambda d: metrics.pr_curve(d, "label", GRAPH)),
        "confusion_matrix": _on("scores_v", lambda d: metrics.confusion_matrix(_predicted(d))),
        "classification_report": _on("scores_v", lambda d: metrics.classification_report(_predicted(d))),
        # models
        "nlp_tfidf": _nlp_tfidf,
        "nlp_score": _scored(NLP),
        "graph_score": _scored(GRAPH),
        "grid_search": _grid_search,
        "train_ensemble": _train_metrics,
        "feature_importances": _importances,
        "ensemble_importances": _ensemble_importances,
        "model_roundtrip": _roundtrip,
        "analyze_model": _analyze_model,
        "score_batch": _score_batch,
    }
