"""Fixed values that results depend on: names, lists, patterns and thresholds."""

# --- fixed values: relation names ---
RELATION_NAMES = {
    "isa": "subClassOf",
    "kindof": "subClassOf",
    "typeof": "subClassOf",
    "subclassof": "subClassOf",
    "contains": "hasPart",
    "consistsof": "partOf",
    "partof": "partOf",
    "haspart": "hasPart",
    "canperform": "hasAbility",
    "hasrole": "hasAbility",
    "performs": "hasAbility",
    "hasability": "hasAbility",
    "causes": "causes",
    "enables": "enables",
    "prevents": "prevents",
    "requires": "requires",
    "relatedto": "relatedTo",
    "associatedwith": "relatedTo",
    "usedin": "relatedTo",
    "appearsin": "relatedTo",
}
TRANSITIVE = ["reports_to", "part_of", "subclass_of", "subClassOf", "contains", "depends_on", "has_part", "is_a"]
SYMMETRIC = ["cooperates_with", "related_to", "equivalent_to", "collaborates_with", "works_with", "connected_to", "associated_with", "sameAs"]
#: The canonical spellings, which the two lists above lack.
TRANSITIVE_CANONICAL = ["partOf", "hasPart"]
SYMMETRIC_CANONICAL = ["relatedTo"]
DOMAIN_RULES = {
    "human resources": {"transitive": ["reports_to"], "symmetric": ["cooperates_with", "collaborates_with"]},
    "software": {"transitive": ["depends_on", "part_of"], "symmetric": ["related_to", "connected_to"]},
}
AXIOM_TYPES = ["disjointness", "symmetry", "transitivity", "asymmetry", "inverse", "functional", "subclass", "domain", "range"]

# --- fixed values: how far a page's site is trusted, first match wins ---
FIDELITY = [
    (1.00, r"(arxiv\.org|pubmed|\.edu|doi\.org|ncbi\.nlm\.nih)"),
    (0.85, r"(docs\.|readthedocs|wiki\.|wikipedia\.org|\.gov)"),
    (0.80, r"(fandom\.com|gamepedia|wikia\.com)"),
    (0.75, r"(gitlab\.com|github\.com|bitbucket\.org)"),
    (0.60, r"(medium\.com|substack\.com)"),
    (0.45, r"(blog\.|wordpress\.com|blogspot\.com)"),
    (0.30, r"(reddit\.com|stackoverflow\.com|stackexchange\.com|quora\.com|discord)"),
]
FIDELITY_DEFAULT = 0.15
FIDELITY_LABELS = [(1.00, "research"), (0.85, "documentation"), (0.75, "gitlab/github"), (0.60, "verified-blog"), (0.45, "blog"), (0.30, "forum"), (0.15, "post")]

# --- fixed values: what isn't a concept, to the repair and to the agent ---
NOISE_PATTERNS = [r"^[\d.%]+$", r"^[a-z_]+\(.*\)$", r"^[A-Za-z_]+\.py$"]
NOISE_NAMES = ["e", "graph", "node", "type", "name", "update_graph", "infer_relations", "update_graph_from_aggregated", "document(s) with sse progress", "ontologyclass"]
NOISE_STARTS = ["_", "get ", "set ", "a ", "an ", "the "]
AGENT_NOISE_NAMES = ["e", "100%", "switch aggro", "the game", "middle of the pack"]
CONCEPT_STARTS = ["a ", "an ", "the ", "a type of", "a technique", "a role", "a goal", "a group of", "a designated", "a character", "a player", "a defensive", "ai-controlled", "player-controlled", "equipment or", "goals that", "goals within", "key goals", "key targets", "one of the"]
AGENT_NOISE_STARTS = ["a ", "an ", "the ", "a type of", "a technique", "a role", "a goal", "a group of", "a designated", "a character", "a player", "a defensive", "ai-controlled", "player-controlled", "equipment or", "goals that", "goals within", "key goals", "key targets", "one of the", "minions that"]
REFUSALS = ["I DON'T", "I CANNOT", "I COULD NOT", "UNABLE", "NO "]

# --- fixed values: words that answers are compared without ---
STOPWORDS = "a an the and or but in on at to for of with by from as is are was were be been being have has had do does did will would could should may might must can shall".split()

# --- fixed values: XSD types of data property tags ---
XSD = {"string": "string", "str": "string", "int": "integer", "integer": "integer", "float": "double", "double": "double", "number": "decimal", "date": "date", "datetime": "dateTime", "boolean": "boolean", "bool": "boolean"}

# --- fixed values: hints at a graph's domain ---
DOMAIN_HINTS = [
    (["champion", "summoner", "rift", "lol", "league of legends", "ability power", "summoner spell"], "League of Legends"),
    (["pokemon", "pokémon", "pikachu", "trainer", "gym", "evolution"], "Pokémon"),
    (["minecraft", "block", "mob", "biome", "crafting"], "Minecraft"),
]

# --- fixed values: thresholds ---
INFER_CONFIDENCE, LOW_CORRECTNESS, MAX_ITERATIONS = 0.65, 0.3, 20
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 300
TOKEN_OVERLAP, CANONICAL_COSINE, ORPHAN_COSINE, BRIDGE_COSINE = 0.8, 0.85, 0.75, 0.6
#: With more components than that, bridges need less.
MANY_COMPONENTS, MANY_COSINE = 20, 0.7
GROUNDED_RATIO = 0.6
GRADES = [(0.8, "A"), (0.6, "B"), (0.4, "C"), (0.2, "D"), (0.0, "F")]
HUB_DEGREE = 80
