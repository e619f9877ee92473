"""Fixed values that define results; they must equal those that existing corpora were built with."""

CHUNK_SIZE, CHUNK_OVERLAP = 2000, 0
SECTION_CHUNK_MIN, SECTION_CHUNK_MAX, OVERLAP_SENTENCES = 200, 1000, 2
ENTITY_PART_CHARS = 2000
NOTEBOOK_TARGET_TOKENS, NOTEBOOK_MAX_TOKENS, CHARS_PER_TOKEN = 400, 800, 4
CASCADE_FACTOR, CASCADE_SHARE, CASCADE_MOST = 70, 0.5, 400
HOPFIELD_BETA = 22.0
CONCEPT_WEIGHT, EXACT_FACTOR, PARTIAL_FACTOR, NAME_BONUS, RELATED_FACTOR = 0.3, 1.35, 0.25, 0.1, 0.7
HEADER_BOOST, FIRST_PARAGRAPH_BOOST, PARTIAL_BOOST = 1.2, 1.1, 0.9
FUZZY_NAME_RATIO = 85
TOP_CONCEPTS, RELATION_CONFIDENCE, MOST_RESULTS = 10, 0.45, 20
DOCUMENT_CONCEPTS, SECTION_CONCEPTS = 5, 8

FRENCH_WORDS = "le la les de du des et en un une est pour dans par sur au que qui ce cette".split()
ENGLISH_WORDS = "the of and to in a is for on with by that this as it from are be at".split()
KEYWORD_STOPS = "le la les de du des et en un une est pour dans par sur au que qui ce cette ces il elle ils elles on nous vous je tu".split()
