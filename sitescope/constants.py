"""Domain constants.

FIXED VALUES — these must equal the reference application's values for equal
results; they are stated here as plain text, in natural order, together.
"""

# ---- fixed values -----------------------------------------------------------
SOIL_CODES = {"Clay": 0, "Loamy": 1, "Sandy": 2, "Silty": 3}
SOIL_FALLBACK_CODE = 1  # Loamy

FEATURE_COLS = ["Elevation", "Slope", "Rainfall", "Soil_Type",
                "Temperature", "NDVI", "Soil_Moisture", "Elevation_Zone"]
REQUIRED_SITE_COLS = ["Elevation", "Slope", "Rainfall", "Soil_Type", "Suitability"]
REQUIRED_BATCH_COLS = ["Elevation", "Slope", "Rainfall", "Soil_Type"]
REQUIRED_DISTRICT_COLS = ["state", "district", "elevation", "annual_rainfall"]
NUMERIC_INPUTS = ["Elevation", "Slope", "Rainfall"]
LABEL_COL = "Suitability"

# elevation zone upper edges (inclusive) and names
ZONE_EDGES = [500.0, 1500.0, 2500.0]
ZONE_NAMES = ["Lowland", "Mid-Hill", "Highland", "Alpine"]

# feature formulas
TEMP_SEA_LEVEL = 30.0
TEMP_LAPSE_PER_M = 0.006
NDVI_BASE = 0.2
NDVI_RAIN_SCALE = 2500.0
MOISTURE_RAIN_SCALE = 2000.0
MOISTURE_SLOPE_SCALE = 100.0

# rule score (each part clipped to [0, 1], summed) and label threshold
RULE_ELEV_SCALE = 2000.0
RULE_SLOPE_SCALE = 25.0
RULE_RAIN_OFFSET = 400.0
RULE_RAIN_SCALE = 1000.0
RULE_NDVI_OFFSET = 0.2
RULE_NDVI_SCALE = 0.6
RULE_THRESHOLD = 2.5
RULE_MAX = 4.0

# condition checks: (name, feature column, ideal, op, unit)
CONDITIONS = [
    ("Rainfall", "Rainfall", 600.0, ">=", "mm"),
    ("Slope", "Slope", 20.0, "<=", "°"),
    ("Elevation", "Elevation", 2000.0, "<=", "m"),
    ("NDVI", "NDVI", 0.40, ">=", ""),
    ("Soil Moisture", "Soil_Moisture", 0.10, ">=", ""),
    ("Temperature", "Temperature", 15.0, ">=", "°C"),
]

# confidence tiers: (lower bound inclusive, label, colour), checked in order
CONFIDENCE_TIERS = [
    (0.85, "High Confidence", "#4caf50"),
    (0.65, "Moderate Confidence", "#ff9800"),
]
LOW_TIER = ("Low Confidence — Borderline Case", "#f44336")

CLASS_NAMES = {1: "Suitable", 0: "Not Suitable"}

# random forest hyperparameters of the reference run
FOREST_PARAMS = {
    "numTrees": 200,
    "maxDepth": 12,
    "minInstancesPerNode": 30,
    "featureSubsetStrategy": "sqrt",
    "seed": 42,
}
LEARNING_CURVE_TREES = 50
CV_FOLDS = 5
TEST_FRACTION = 0.20
SPLIT_SEED = 42
MIN_TRAIN_ROWS = 200
RARE_CLASS_ROWS = 10

# input bounds used when no site table exists
FALLBACK_BOUNDS = {"Elevation": (0.0, 3000.0), "Slope": (0.0, 45.0), "Rainfall": (200.0, 2000.0)}

# similarity defaults: matches are scored as moderate slope, neutral soil
SIMILAR_TOP_N = 10
SIMILAR_SLOPE = 5.0
SIMILAR_SOIL = "Loamy"

# annualising daily rainfall; defaults of the roll-up
DAYS_PER_YEAR = 365.0
DEFAULT_ELEVATION = 200.0

# warning thresholds
GAP_GREEN = 0.03
GAP_AMBER = 0.06
WARN_GAP = 0.05
WARN_CV_STD = 0.05

# names under which the columns of a match are shown
DISPLAY_NAMES = {
    "state": "State", "district": "District", "elevation": "Elevation (m)", "annual_rainfall": "Rainfall (mm)",
    "avg_temp": "Avg Temp (°C)", "latitude": "Lat", "longitude": "Lon", "Match_Distance": "Match Distance",
    "Predicted_Suitability": "AI Suitability", "Prediction_Confidence": "AI Confidence",
}

# sample sizes of the exploration views
SCATTER_SAMPLE = 6000
HIST_BINS = 50
CALIBRATION_BINS = 10
# ---- end fixed values -------------------------------------------------------
