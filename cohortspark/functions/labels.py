"""Fixed values.

Everything in this module is a constant that must equal the study's own
values for results to match: raw analyte labels and their short names, cohort
names, plot labels, cutoffs and the significance scale.  They are parameters
everywhere else in the package; these are only the defaults.
"""

# --- fixed values: raw analyte labels -> short names (study scripts) --------
ANALYTE_SHORT_NAMES = {
    "Capsid sub x5": "NC",
    "Membrane sub x5": "M",
    "SNT sub x5": "SNT",
    "SCT sub x5": "SCT",
    "grün sbu x5": "Pepmix (green)",
    "yellow sub x5": "Pepmix (yellow)",
}

# --- fixed values: raw analyte labels -> names used in the German report ----
ANALYTE_LOCALIZED_NAMES = {
    "Capsid sub x5": "Capsid",
    "Membrane sub x5": "Membrane",
    "SNT sub x5": "SNT",
    "SCT sub x5": "SCT",
    "grün sbu x5": "Pepmix (green)",
    "yellow sub x5": "Pepmix (yellow)",
}

# --- fixed values: cohort names --------------------------------------------
CONTROLS = "Controls"
EXPOSED_SERONEGATIVE = "Exposed Seronegative"
EXPOSED_SEROPOSITIVE = "Exposed Seropositive"
PCR_SERONEGATIVE = "PCR+ Seronegative"
PCR_SEROPOSITIVE = "PCR+ Seropositive"
POSITIVE = "Positive"
NEGATIVE = "Negative"

# --- fixed values: cohort sets of the figures -------------------------------
SEROPOSITIVE3 = [EXPOSED_SEROPOSITIVE, PCR_SEROPOSITIVE, PCR_SERONEGATIVE]
NONCONTROL4 = [PCR_SEROPOSITIVE, PCR_SERONEGATIVE, EXPOSED_SEROPOSITIVE, EXPOSED_SERONEGATIVE]

# (group3, serostatus) -> cohort; Controls take any status.
COHORT_RULES = [
    ("PCR+", POSITIVE, PCR_SEROPOSITIVE),
    ("PCR+", NEGATIVE, PCR_SERONEGATIVE),
    ("Exposed", POSITIVE, EXPOSED_SEROPOSITIVE),
    ("Exposed", NEGATIVE, EXPOSED_SERONEGATIVE),
    ("Controls", None, CONTROLS),
]

# --- fixed values: two-line plot labels of the cohorts ----------------------
COHORT_PLOT_LABELS = {
    "Controls": "Controls",
    "Exposed Seronegative": "Exposed\nSeronegative",
    "Exposed Seropositive": "Exposed\nSeropositive",
    "PCR+ Seronegative": "PCR+\nSeronegative",
    "PCR+ Seropositive": "PCR+\nSeropositive",
}

# --- fixed values: German plot labels of the cohorts ------------------------
COHORT_GERMAN_LABELS = {
    "Controls": "Kontrollen",
    "PCR+ Seropositive": "PCR+\nmit Antikörper",
    "PCR+ Seronegative": "PCR+\nohne Antikörper",
    "Exposed Seropositive": "Haushaltsmitglieder\nmit Antikörper",
    "Exposed Seronegative": "Haushaltsmitglieder\nohne Antikörper",
}

# --- fixed values: analyte panels ------------------------------------------
PANEL3 = ["NC", "M", "SCT"]
PANEL4 = ["NC", "M", "SCT", "SNT"]
PANEL3_LOCALIZED = ["Capsid", "Membrane", "SCT"]

# --- fixed values: detection bins of the contingency table ------------------
BIN_LOW = "Less than 2"
BIN_HIGH = "More than 2"
DETECTION_BINS = [([0, 1], BIN_LOW), ([2, 3, 4], BIN_HIGH)]

# --- fixed values: study cutoffs and floors ---------------------------------
STUDY_CUTOFF = 40.0          # IFN-gamma, strictly greater means detected
PLOT_FLOOR = 0.01            # zero replaced for plots and the rank-sum figure
TEST_FLOOR = 0.1             # zero replaced for paired tests, correlations

# --- fixed values: significance symbols (upper bounds, inclusive) -----------
SIGNIFICANCE_SCALE = [(1e-4, "****"), (1e-3, "***"), (1e-2, "**"),
                      (0.05, "*"), (1.0, "ns")]
