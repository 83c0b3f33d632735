"""Default parameters of the retrieval and answering jobs (fixed values)."""

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
EMBEDDING_DIM = 256
SEARCH_TOP_K = 10
SEARCH_MAX_K = 50
CANDIDATE_POOL = 40
RRF_K = 60
ANSWER_TOP_K = 8
ANSWER_MAX_K = 30
MAX_CHUNKS_PER_TRIAL = 20
MIN_CITABLE_LENGTH = 25
GROUPED_SEARCH_K = 30
CARD_EXCERPT_LENGTH = 320
CITATION_EXCERPT_LENGTH = 500
EXPECTED_QUESTIONS = (20, 15, 5)

MODES = ("hybrid", "fulltext", "dense")
