"""Vocabularies and thresholds that results depend on."""

# Taxonomic classes outside the screening mandate.
EXCLUDED_CLASSES = (
    "Arachnida", "NA", "Insecta", "Amphibia", "Aves", "Hirudinoidea", "Secernentea", "Ulvophyceae",
    "Reptilia", "Phaeophyceae", "Hydrozoa", "Cestoda", "Ascidiacea", "Trematoda", "Copepoda",
    "Adenophorea", "Myxosporea Myxobolus cerebralis", "Diplopoda", "Ophiuroidea", "Pinopsida",
    "Cephalopoda", "Chlorophyceae",
)

# Organism groups kept when a regional list is compared.
KEPT_GROUPS = (
    "Coelenterates-Hydrozoans", "Crustaceans-Amphipods", "Crustaceans-Cladocerans",
    "Crustaceans-Crayfish", "Fishes", "Mollusks-Bivalves", "Mollusks-Gastropods", "Plants",
)

# Habitat strings that count as freshwater, per list format.
FRESHWATER_JSON_HABITATS = (
    '["freshwater"]', '["freshwater","brackish","marine"]', '["terrestrial","freshwater"]',
)
FRESHWATER_PIPE_HABITATS = (
    "FRESHWATER", "FRESHWATER|MARINE", "FRESHWATER|TERRESTRIAL", "FRESHWATER|TERRESTRIAL|HOST",
)

# Record selection and coordinate quality.
EXCLUDED_RECORD_BASES = (
    "FOSSIL_SPECIMEN", "LIVING_SPECIMEN", "HUMAN_OBSERVATION", "PRESERVED_SPECIMEN", "OBSERVATION",
)
FIRST_RECORD_YEAR = 1990
MAX_COORDINATE_PRECISION = 0.01
MAX_COORDINATE_UNCERTAINTY = 10000
PLACEHOLDER_UNCERTAINTIES = (301, 3036, 999, 9999)
SITE_BUFFER_METRES = 2000.0

# Name resolution.
NAME_SOURCE = "Integrated Taxonomic Information SystemITIS"
MIN_NAME_SCORE = 0.8

# Odd names and their replacements.
NAME_FIXES = {
    "Sander volgensis or Sander marinus": "Sander volgensis",
    "Morone mississippiensis and hybrids": "Morone mississippiensis",
}

# Climate scenarios.
BASELINE_SCENARIO = "1981-2010"
FUTURE_SCENARIO = "2011-2040"

# Climate layers are BIO1 and BIO5 to BIO19.
CLIMATE_LAYERS = tuple(f"bio{i:02d}" for i in (1, *range(5, 20)))

# Risk tiers and second-look spellings.
HIGH_RISK_RANGE = (7, 12)
SECOND_LOOK_FLAGS = ("Yes", "yes", "uncertain", "Maybe", "maybe")

# Introduction vectors as (in-take column, count label).
VECTORS = {
    "pet_aquarium": "n_aquaria",
    "aquaculture": "n_aquaculture",
    "rec_fish": "n_recFish",
    "biofouler": "n_boifouling",
    "bilge_water": "n_bilge",
    "water_garden": "n_waterGarden",
}
