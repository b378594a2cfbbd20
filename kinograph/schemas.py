"""One StructType per table; writes always select these names, never positions."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _N = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                          T.BooleanType(), T.TimestampNTZType())
_A = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMA_VERSION = 2

TITLES = _struct(
    item_id=_L, imdb_id=_S, tmdb_id=_L, movielens_id=_L, kind=_S, title=_S, original_title=_S,
    year=_I, end_year=_I, runtime=_I, genres=_A, language=_S, languages=_A, countries=_A,
    imdb_rating=_D, imdb_votes=_L, tmdb_rating=_D, tmdb_votes=_L, popularity=_D, directors=_A,
    writers=_A, cast_names=_A, keywords=_A, overview=_S, tagline=_S, poster_path=_S, adult=_B,
    quality=_D, enriched_at=_N, keywords_at=_N,
)
EVENTS = _struct(event_id=_L, user_id=_L, ts=_N, item_id=_L, kind=_S, value=_D, source=_S, context=_S)
IMPRESSIONS = _struct(
    impression_id=_L, user_id=_L, ts=_N, item_id=_L, slate_id=_S, position=_I, score=_D,
    propensity=_D, explored=_B, policy=_S,
)
META = _struct(key=_S, value=_S, written_at=_N)
BATCHES = T.StructType([
    T.StructField("batch_id", _S), T.StructField("user_id", _L), T.StructField("created_at", _N),
    T.StructField("item_ids", T.ArrayType(_L)), T.StructField("full_ranking", T.ArrayType(_L)),
    T.StructField("ridge_ranking", T.ArrayType(_L)), T.StructField("manifest_id", _S),
])
CASES = _struct(
    case_id=_S, batch_id=_S, user_id=_L, item_id=_L, sealed_at=_N, full_score=_D, full_std=_D,
    full_like_prob=_D, ridge_score=_D, ridge_like_prob=_D, status=_S, actual_reward=_D,
    actual_verdict=_S, revealed_at=_N,
)
RATINGS = _struct(userId=_I, movieId=_I, rating=T.FloatType())
EXPORT_LINE = _struct(imdb_id=_S, title=_S, year=_L, kind=_S, value=_D, source=_S, ts=_S, context=_S)

# Landed API records: one wide optional structure, so one reader fits every payload shape.
_NAMED = T.ArrayType(_struct(id=_L, name=_S))
_HIT = T.StructType([
    *_struct(id=_L, overview=_S, original_language=_S, original_title=_S, original_name=_S,
             popularity=_D, vote_average=_D, vote_count=_L, poster_path=_S),
    T.StructField("genre_ids", T.ArrayType(_L)),
])
FIND = T.StructType([
    T.StructField("movie_results", T.ArrayType(_HIT)), T.StructField("tv_results", T.ArrayType(_HIT)),
])
_KEYWORDS = T.StructType([T.StructField("keywords", _NAMED), T.StructField("results", _NAMED)])
DETAIL = T.StructType([
    *_struct(id=_L, title=_S, name=_S, original_title=_S, original_name=_S, overview=_S, tagline=_S,
             original_language=_S, popularity=_D, vote_average=_D, vote_count=_L, poster_path=_S,
             release_date=_S, first_air_date=_S, runtime=_L, adult=_B),
    T.StructField("episode_run_time", T.ArrayType(_L)),
    T.StructField("genres", _NAMED),
    T.StructField("keywords", _KEYWORDS),
    T.StructField("external_ids", _struct(imdb_id=_S)),
    T.StructField("spoken_languages", T.ArrayType(_struct(iso_639_1=_S))),
    T.StructField("production_countries", T.ArrayType(_struct(iso_3166_1=_S))),
    T.StructField("credits", T.StructType([
        T.StructField("crew", T.ArrayType(_struct(job=_S, department=_S, name=_S))),
        T.StructField("cast", T.ArrayType(_struct(name=_S))),
    ])),
])

DUMPS = {
    "title.basics": "tconst titleType primaryTitle originalTitle isAdult startYear endYear runtimeMinutes genres",
    "title.ratings": "tconst averageRating numVotes",
    "title.akas": "titleId ordering title region language types attributes isOriginalTitle",
    "title.crew": "tconst directors writers",
    "title.principals": "tconst ordering nconst category job characters",
    "name.basics": "nconst primaryName birthYear deathYear primaryProfession knownForTitles",
}


def dump_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, _S) for c in DUMPS[name].split()])
