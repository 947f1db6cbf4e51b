"""Codebook of the three-wave survey: question codes, variables and labels.

Everything here is a fixed value that results depend on.
"""

from __future__ import annotations

KEY = "USER_ID"

# Baseline answers. (variable, candidate columns, codes for 1, codes for 0)
BASELINE_CODES = [
    ("male", ["SEX", "Sex", "sex"], [1], [2]),
    ("low_edu", ["Q12", "q12"], [1, 2], "other_non_null"),
    ("low_income", ["Q10", "q10"], [1, 2, 3, 4], "other_non_null"),
    ("living_alone", ["Q7.1", "Q7_1", "Q7"], [1], "other_non_null"),
    ("lack_social_support", ["Q17.7", "Q17_7", "Q17"], [1, 2, 3], "other_non_null"),
    ("current_smoking", ["Q9", "q9"], [1, 2], "other_non_null"),
    ("no_health_checkup", ["Q34.3", "Q34_3"], [2], [1]),
    ("poor_self_rated_health", ["Q78", "q78"], [4, 5], [1, 2, 3]),
]
AGE = ["AGE", "Age", "age"]
DRINK_FREQUENCY, DRINK_AMOUNT = ["Q41", "q41"], ["Q42", "q42"]
WALKING, VIGOROUS = ["Q25.4", "Q25_4"], ["Q25.7", "Q25_7"]
HEIGHT_CM, WEIGHT_KG = ["Q83.1", "Q83_1"], ["Q83.2", "Q83_2"]
BMI_RANGE = (10.0, 60.0)

COVARIATES = [
    "male", "age", "low_edu", "low_income", "living_alone", "lack_social_support", "current_smoking", "heavy_drinking",
    "low_physical_activity", "no_health_checkup", "poor_self_rated_health", "bmi",
]

# Raw baseline columns of the follow-up model.
FOLLOW_UP_COLUMNS = [
    ["SEX"], ["AGE"], ["Q12"], ["Q10"], ["Q7.1", "Q7_1"], ["Q17.7", "Q17_7"], ["Q9"], ["Q41"], ["Q42"],
    ["Q83.1", "Q83_1"], ["Q83.2", "Q83_2"], ["Q25.4", "Q25_4"], ["Q25.7", "Q25_7"], ["Q34.3", "Q34_3"], ["Q78"],
]

# The exposure score.
SCORE_QUESTION, SCORE_ITEMS, SCORE_REVERSED, SCORE_TOP, SCORE_MIN_ANSWERED = "Q32", range(1, 14), range(9, 13), 5, 10
SCORE_RANGE, SCORE_REFERENCE = (13, 52), 29
SCORE, SCORE_Z, SCORE_QUARTILE, SCORE_TERTILE, SCORE_HIGH = (
    "HI_sum_22", "HI_z_22", "HI_quartile_22", "HI_tertile_22", "High_HI_22",
)
EXPOSURES = [SCORE, SCORE_HIGH]
EXPOSURE_MARKS = ("HI_", "High_HI")

# Outcome answers. (variable, candidate columns, codes for 1, codes for 0)
HOSPITAL = ("HospitalizationPastYear_23", ["Q91", "q91"], [1], "other_non_null")
COVID_VACCINE = ("COVID19_Vaccination_23", ["Q20", "q20"], [1, 2, 3, 4, 5], [6, 7, 8, 9])
FLU_VACCINE = ("InfluenzaVaccination_23", ["Q37.10", "Q37_10"], [1], [2])
INFECTION, INFECTION_QUESTION, INFECTION_ITEMS = "COVID19_Infection_23", "Q23", range(1, 5)
INFECTION_RECENT, INFECTION_NOT_RECENT = range(1, 4), range(4, 6)

# Item numbers of question 89; codes 3-5 mean yes, 1-2 no.
DISEASES = {
    "Hypertension_23": 1, "Diabetes_23": 2, "Dyslipidemia_23": 3, "Asthma_23": 5, "Periodontitis_23": 8, "DentalCaries_23": 9,
    "AnginaMI_23": 10, "Stroke_23": 11, "COPD_23": 12, "CKD_23": 13, "ChronicLiverDisease_23": 14, "Cancer_23": 16,
    "ChronicPain_23": 17, "Depression_23": 18,
}
# Item numbers of question 26; 3 and above means yes.
SYMPTOMS = {
    "GIDiscomfort_23": 1, "BackPain_23": 2, "JointPain_23": 3, "Headache_23": 4, "ChestPain_23": 5, "Dyspnea_23": 6,
    "Dizziness_23": 7, "SleepDisturbance_23": 9, "MemoryDisorder_23": 13, "ConcentrationDecline_23": 14,
    "ReducedLibido_23": 17, "Fatigue_23": 18, "Cough_23": 19, "Fever_23": 20,
}
FIRST_OUTCOMES = ["HospitalizationPastYear_23", "COVID19_Vaccination_23", "InfluenzaVaccination_23", "COVID19_Infection_23"]
OUTCOMES = [*FIRST_OUTCOMES, *DISEASES, *SYMPTOMS]
PRIMARY_OUTCOME = "HospitalizationPastYear_23"
PROFILED_OUTCOMES = ["COVID19_Infection_23", "HospitalizationPastYear_23", "COVID19_Vaccination_23"]
CONTRAST_OUTCOMES = ["HospitalizationPastYear_23", "COVID19_Vaccination_23", "Depression_23", "Hypertension_23"]
RISK_OUTCOMES = ["HospitalizationPastYear_23", "COVID19_Vaccination_23"]

WEIGHT, FOLLOWED = "ipcw_weight", "complete3"
IMPUTATIONS, IMPUTATION_ROUNDS, SEED = 5, 25, 2025

# Strata of the stratified analysis. (category, column, [(value, label)])
STRATA = [
    ("Age", "age_group", [(0, "Age <65"), (1, "Age ≥65")]),
    ("Sex", "male", [(0, "Female"), (1, "Male")]),
    ("SES", "low_income", [(0, "Higher SES"), (1, "Lower SES")]),
]
AGE_EDGES = [0, 65, 100]

# Graph discovery.
GRAPH_BASELINE = [
    "male", "low_edu", "lack_social_support", "current_smoking", "no_health_checkup", "low_income", "living_alone", "age",
    "poor_self_rated_health", "heavy_drinking", "low_physical_activity", "bmi",
]
GRAPH_DISEASES = ["HospitalizationPastYear_23", "COVID19_Infection_23", "COVID19_Vaccination_23", "InfluenzaVaccination_23", *DISEASES]
GRAPH_SYMPTOMS = list(SYMPTOMS)
GRAPH_SUBSETS = {"disease": [*GRAPH_BASELINE, SCORE, *GRAPH_DISEASES], "symptoms": [*GRAPH_BASELINE, SCORE, *GRAPH_SYMPTOMS]}
GRAPH_FOLDS, GRAPH_MIN_FOLDS = 10, 6
IMMUTABLE_MASK, IMMUTABLE_FILTER = ["male", "age"], ["age", "male", "low_edu"]

# Display labels.
FOREST_LABELS = {
    "HospitalizationPastYear_23": "Hospitalization", "COVID19_Vaccination_23": "COVID-19 Vaccination",
    "InfluenzaVaccination_23": "Influenza Vaccination", "COVID19_Infection_23": "COVID-19 Infection",
    "DentalCaries_23": "Dental Caries", "AnginaMI_23": "Angina/MI", "ChronicLiverDisease_23": "Chronic Liver Disease",
    "ChronicPain_23": "Chronic Pain", "GIDiscomfort_23": "GI Discomfort", "BackPain_23": "Back Pain",
    "JointPain_23": "Joint Pain", "ChestPain_23": "Chest Pain", "SleepDisturbance_23": "Sleep Disturbance",
    "MemoryDisorder_23": "Memory Disorder", "ConcentrationDecline_23": "Concentration Decline",
    "ReducedLibido_23": "Reduced Libido",
}
NETWORK_LABELS = {
    "male": "Male", "age": "Age", "low_edu": "Low education", "low_income": "Low income", "living_alone": "Live alone",
    "lack_social_support": "No social support", "current_smoking": "Smoking", "heavy_drinking": "Heavy Drink",
    "low_physical_activity": "Low physical activity", "no_health_checkup": "No health checkup",
    "poor_self_rated_health": "Poor self rated health", "bmi": "BMI",
    "HI_sum_22": "Health indifference", "High_HI_22": "High health indifference",
    "HospitalizationPastYear_23": "Hospitalization",
    "COVID19_Infection_23": "COVID Infection", "COVID19_Vaccination_23": "COVID Vaccination",
    "InfluenzaVaccination_23": "Flu Vaccination", "Diabetes_23": "Diabetes mellitus", "DentalCaries_23": "Dental caries",
    "AnginaMI_23": "Angina/Myocardial infarction", "CKD_23": "Chronic kidney disease",
    "ChronicLiverDisease_23": "Liver Disease", "ChronicPain_23": "Chronic pain", "GIDiscomfort_23": "GI Discomfort",
    "BackPain_23": "Back Pain", "JointPain_23": "Joint Pain", "ChestPain_23": "Chest Pain",
    "SleepDisturbance_23": "Sleep disturbance", "MemoryDisorder_23": "Memory disorder",
    "ConcentrationDecline_23": "Concentration decline", "ReducedLibido_23": "Low Libido",
}
# Rows of the baseline table. (variable, label, kind)
TABLE_ROWS = [
    ("HI_sum_22", "HI score (2022), mean±SD", "continuous"),
    ("age", "Age (2021), years, mean±SD", "continuous"),
    ("male", "Male sex, n (%)", "binary"),
    ("low_edu", "Low education (<HS), n (%)", "binary"),
    ("low_income", "Low household income, n (%)", "binary"),
    ("living_alone", "Living alone, n (%)", "binary"),
    ("lack_social_support", "Lack of social support, n (%)", "binary"),
    ("current_smoking", "Current smoking, n (%)", "binary"),
    ("heavy_drinking", "Heavy drinking, n (%)", "binary"),
    ("low_physical_activity", "Low physical activity, n (%)", "binary"),
    ("no_health_checkup", "No health checkup, n (%)", "binary"),
    ("poor_self_rated_health", "Poor self-rated health, n (%)", "binary"),
    ("bmi", "BMI (2021), kg/m², mean±SD", "continuous"),
    ("HospitalizationPastYear_23", "Hospitalization past year (2023), n (%)", "binary"),
    ("COVID19_Infection_23", "COVID-19 infection (2023), n (%)", "binary"),
    ("COVID19_Vaccination_23", "COVID-19 vaccination (2023), n (%)", "binary"),
    ("InfluenzaVaccination_23", "Influenza vaccination (2023), n (%)", "binary"),
    ("Hypertension_23", "Hypertension (2023), n (%)", "binary"),
    ("Diabetes_23", "Diabetes mellitus (2023), n (%)", "binary"),
    ("Dyslipidemia_23", "Dyslipidemia (2023), n (%)", "binary"),
    ("Asthma_23", "Asthma (2023), n (%)", "binary"),
    ("Periodontitis_23", "Periodontitis (2023), n (%)", "binary"),
    ("DentalCaries_23", "Dental caries (2023), n (%)", "binary"),
    ("AnginaMI_23", "Angina/MI (2023), n (%)", "binary"),
    ("Stroke_23", "Stroke (2023), n (%)", "binary"),
    ("COPD_23", "COPD (2023), n (%)", "binary"),
    ("CKD_23", "Chronic kidney disease (2023), n (%)", "binary"),
    ("ChronicLiverDisease_23", "Chronic liver disease (2023), n (%)", "binary"),
    ("Cancer_23", "Cancer (2023), n (%)", "binary"),
    ("ChronicPain_23", "Chronic pain (2023), n (%)", "binary"),
    ("Depression_23", "Depression (2023), n (%)", "binary"),
    ("GIDiscomfort_23", "GI discomfort (2023), n (%)", "binary"),
    ("BackPain_23", "Back pain (2023), n (%)", "binary"),
    ("JointPain_23", "Joint pain (2023), n (%)", "binary"),
    ("Headache_23", "Headache (2023), n (%)", "binary"),
    ("ChestPain_23", "Chest pain (2023), n (%)", "binary"),
    ("Dyspnea_23", "Dyspnea (2023), n (%)", "binary"),
    ("Dizziness_23", "Dizziness (2023), n (%)", "binary"),
    ("SleepDisturbance_23", "Sleep disturbance (2023), n (%)", "binary"),
    ("MemoryDisorder_23", "Memory disorder (2023), n (%)", "binary"),
    ("ConcentrationDecline_23", "Concentration decline (2023), n (%)", "binary"),
    ("ReducedLibido_23", "Reduced libido (2023), n (%)", "binary"),
    ("Fatigue_23", "Fatigue (2023), n (%)", "binary"),
    ("Cough_23", "Cough (2023), n (%)", "binary"),
    ("Fever_23", "Fever (2023), n (%)", "binary"),
]
