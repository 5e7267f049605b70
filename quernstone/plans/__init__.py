

from quernstone.plans import (  # noqa: F401  each registers its queries
    corpus_queries,
    graph_queries,
    io_queries,
    retrieval_queries,
    serving_queries,
    stream_queries,
    text_queries,
)
