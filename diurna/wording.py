"""The wording of outcomes, in rule order.

Texts are part of the result, so they are stated here once, as they are shown.
"""


# Depression risk
MILD_PHQ_9 = "mild PHQ-9 score"
MODERATE_PHQ_9 = "moderate PHQ-9 score"
SEVERE_PHQ_9 = "severe PHQ-9 score"
VERY_SEVERE_PHQ = "very severe PHQ-9 score"
MINIMAL_DEPRESSIVE_SYMPTOMS = "Minimal depressive symptoms"
MILD_DEPRESSIVE_SYMPTOMS = "Mild depressive symptoms"
MODERATE_DEPRESSION_INDICATED = "Moderate depression indicated"
SEVERE_DEPRESSION_INDICATED = "Severe depression indicated"
VERY_SEVERE_DEPRESSION = "Very severe depression"
SLEEP_DATA = "sleep data"
ACTIVITY_DATA = "activity data"
SEVERE_INSOMNIA = "severe insomnia"
SEVERE_HYPOACTIVITY = "severe hypoactivity"
SUICIDAL_IDEATION = "suicidal ideation"
SUICIDAL_IDEATION_PRESENT = "Suicidal ideation present - immediate intervention required"
WITH_SEVERE_BIOMARKER = " with severe biomarker severity"
LIMITED_DATA = " (limited data: "

# Mania risk
ELEVATED_ASRM_SCORE = "elevated ASRM score"
HIGH_ASRM_SCORE = "high ASRM score"
VERY_HIGH_ASRM = "very high ASRM score"
REDUCED_SLEEP = "reduced sleep"
PSYCHOTIC_FEATURES = "psychotic features"
MANIC_EPISODE_WITH = "Manic episode with psychotic features - immediate intervention required"
NO_MANIC_SYMPTOMS = "No manic symptoms detected"
HYPOMANIC_SYMPTOMS_PRESENT = "Hypomanic symptoms present"
MANIC_EPISODE_LIKELY = "Manic episode likely"
SEVERE_MANIC_EPISODE = "Severe manic episode"

# Mixed risk
SLEEP_DISTURBANCE = "sleep disturbance"
RACING_THOUGHTS = "racing thoughts"
INCREASED_ENERGY = "increased energy"
SEVERE_MIXED_EPISODE = "Severe mixed episode"
MIXED_MOOD_EPISODE = "Mixed mood episode with multiple features"
MIXED_FEATURES_PRESENT = "Mixed features present"
POSSIBLE_MIXED_STATE = "Possible mixed state"
CONCURRENT_DEPRESSION_AND = "concurrent depression and mania symptoms"

# Depression reading
DEPRESSION_SCREENING_WITHIN = "Depression screening within normal range."
MILD_DEPRESSIVE_SYMPTOMS_BELOW = "Mild depressive symptoms below clinical threshold."
MODERATE_DEPRESSION_DETECTED = "Moderate depression detected requiring clinical attention."
MODERATELY_SEVERE_DEPRESSION = "Moderately severe depression requiring prompt intervention."
SEVERE_DEPRESSION_REQUIRING = "Severe depression requiring immediate intervention."
HYPERSOMNIA_PATTERN_DETECTED = " Hypersomnia pattern detected."
SEVERE_ACTIVITY_REDUCTION = " Severe activity reduction noted."
SUICIDAL_IDEATION_PRESENT_URGENT = " Suicidal ideation present - urgent assessment needed."

# Mania reading
MANIC_EPISODE_WITH_PSYCHOTIC = "Manic episode with psychotic features - immediate hospitalization may be required."
MANIA_SCREENING_WITHIN = "Mania screening within normal range."
HYPOMANIC_SYMPTOMS_DETECTED = "Hypomanic symptoms detected requiring monitoring."
SIGNIFICANT_HYPOMANIC_SYMPTOMS = "Significant hypomanic symptoms requiring intervention."
SEVERE_MANIC_SYMPTOMS = "Severe manic symptoms requiring immediate intervention."
CRITICAL_SLEEP_REDUCTION = " Critical sleep reduction indicates mania."
SIGNIFICANTLY_ELEVATED_ACTIVITY = " Significantly elevated activity level."

# Mixed episode
MAJOR_DEPRESSIVE_EPISODE = "Major depressive episode with mixed features detected."
MANIC_EPISODE_WITH_MIXED = "Manic episode with mixed features detected."

# biomarkers
CRITICAL_SHORT_SLEEP = "Critical short sleep duration indicates mania risk"
POOR_SLEEP_EFFICIENCY = "Poor sleep efficiency"
HIGHLY_VARIABLE_SLEEP = "Highly variable sleep schedule"
SIGNIFICANTLY_ELEVATED_ACTIVITY_LEVEL = "Significantly elevated activity level"
EXTREME_ACTIVITY_ELEVATION = "Extreme activity elevation"
MINIMAL_REST_PERIODS = "Minimal rest periods"
SEVERE_ACTIVITY_REDUCTION_2 = "Severe activity reduction"
SIGNIFICANT_CIRCADIAN_PHASE = "Significant circadian phase advance"
LOW_CIRCADIAN_RHYTHM = "Low circadian rhythm stability"
HIGH_CIRCADIAN_FRAGMENTATION = "High circadian fragmentation"
DIGITAL_BIOMARKERS_INDICATE = "Digital biomarkers indicate %d mania risk factors and %d depression risk factors"

# criteria
EPISODE_DURATION_OF = "Episode duration of %d days meets DSM-5 criteria"
HOSPITALIZATION_OVERRIDES_DURATION = " (hospitalization overrides duration requirement)"
HOSPITALIZATION_INVALIDATES_HYPOMANIC = "Hospitalization invalidates hypomanic episode (would be manic)"
DURATION_INSUFFICIENT_FOR = "Duration insufficient for %s episode (%d days < %d days required)"
HOSPITALIZATION_REQUIRED = "hospitalization required"
DOES_NOT_MEET = "Does not meet"
DSM_5_CRITERIA = " DSM-5 criteria for "

# Early warnings
SIGNIFICANT_SLEEP_INCREASE = "Significant sleep increase"
MAJOR_ACTIVITY_REDUCTION = "Major activity reduction"
CIRCADIAN_PHASE_DELAY = "Circadian phase delay"
SIGNIFICANT_SLEEP_REDUCTION = "Significant sleep reduction"
MAJOR_ACTIVITY_INCREASE = "Major activity increase"
INCREASED_SPEECH_RATE = "Increased speech rate"

# interventions
IMMEDIATE_PSYCHIATRIC_EVALUATION = "Immediate psychiatric evaluation required"
INCREASE_MONITORING_FREQUENCY = "Increase monitoring frequency"
REVIEW_AND_OPTIMIZE = "Review and optimize sleep hygiene"
CONSIDER_PROPHYLACTIC_MEDICATION = "Consider prophylactic medication adjustment"
SCHEDULE_URGENT_CLINICAL = "Schedule urgent clinical evaluation"
INITIATE_ACUTE_TREATMENT = "Initiate acute treatment protocol"
DAILY_SYMPTOM_MONITORING = "Daily symptom monitoring"
SIGNIFICANT_SLEEP_DISRUPTION = "significant sleep disruption"
HISTORY_OF_MULTIPLE = "history of multiple episodes"
EARLY_WARNING_SIGNS = " early warning signs"
INTERVENTION_RECOMMENDED_DUE = "Intervention recommended due to: "

# assessment
MISSING_DEPRESSION_SCREENING = "Missing depression screening data"
MISSING_SLEEP_DATA = "Missing sleep data"
PATIENT_PRESENTS_WITH = "Patient presents with "
RISK_LEVEL_CLINICAL = " risk level. Clinical presentation "
DOES_NOT_MEET_2 = "does not meet"
DSM_5_CRITERIA_2 = " DSM-5 criteria."

# Clinical summary
MAJOR_DEPRESSIVE_EPISODE_2 = "major depressive episode"
CLINICAL_ASSESSMENT_INDICATES = "Clinical assessment indicates "
MEETING_DSM_5 = "meeting DSM-5 criteria"
CONFIDENCE = "(confidence: %d%%)"
PHQ_SCORE = "PHQ score: %d"

# Adjusted confidence
INSUFFICIENT_DATA_COMPLETENESS = "Insufficient data completeness"
LIMITED_HISTORICAL_DATA = "Limited historical data (%d days)"
MISSING_CRITICAL_FEATURES = "Missing critical features: "

# interpretation
MIXED_EPISODE = "Mixed Episode"
EUTHYMIC_STABLE = "Euthymic (Stable)"
SEVERE_DEPRESSIVE_EPISODE = "Severe Depressive Episode"
MODERATE_DEPRESSIVE_EPISODE = "Moderate Depressive Episode"
MILD_DEPRESSIVE_EPISODE = "Mild Depressive Episode"
SUBCLINICAL_DEPRESSION = "Subclinical Depression"
MANIC_EPISODE = "Manic Episode"
HYPOMANIC_EPISODE_WITH = "Hypomanic Episode with Manic Features"
SUBCLINICAL_MANIA = "Subclinical Mania"
HYPOMANIC_EPISODE = "Hypomanic Episode"
MILD_HYPOMANIC_EPISODE = "Mild Hypomanic Episode"
SUBCLINICAL_HYPOMANIA = "Subclinical Hypomania"

# Notes and advice
MIXED_MOOD_EPISODE_DETECTED = "Mixed mood episode detected - simultaneous depressive and manic symptoms"
HIGH_RISK_STATE = "High risk state requiring immediate intervention"
MEETS_DSM_5 = "Meets DSM-5 criteria for mixed features specifier"
PATIENT_SHOWS_STABLE = "Patient shows stable mood indicators"
ALL_MOOD_SCORES = "All mood scores within normal range"
PATIENT_SHOWS_STRONG = "Patient shows strong indicators of depression (score: %.2f)"
SEVERITY_LEVEL_SUGGESTS = "Severity level suggests significant functional impairment"
MEETS_DSM_5_CRITERIA = "Meets DSM-5 criteria for major depressive episode"
PATIENT_EXHIBITS_MANIC = "Patient exhibits manic symptoms (score: %.2f)"
HIGH_RISK_OF = "High risk of impulsive behavior and poor judgment"
CONSISTENT_WITH_DSM = "Consistent with DSM-5 criteria for manic episode"
PATIENT_SHOWS_HYPOMANIA = "Patient shows hypomania symptoms (score: %.2f)"
MONITOR_FOR_POTENTIAL = "Monitor for potential escalation to mania"
MEETS_DSM_5_CRITERIA_FOR = "Meets DSM-5 criteria for hypomanic episode"
SECONDARY_DEPRESSION_RISK = "Secondary depression risk detected (%.2f)"
ELEVATED_MOOD_SYMPTOMS = "Elevated mood symptoms present as secondary feature"
MIXED_FEATURES_PRESENT_INCREASED = "Mixed features present - increased suicide risk"
MIXED_EPISODE_PER = "Mixed episode per DSM-5 criteria - requires urgent care"
EMERGENCY_PSYCHIATRIC_EVALUATION = "Emergency psychiatric evaluation required"
CRISIS_INTERVENTION_TEAM = "Crisis intervention team consultation"
CONSIDER_IMMEDIATE_HOSPITALIZATION = "Consider immediate hospitalization"
URGENT_PSYCHIATRIC_EVALUATION = "Urgent psychiatric evaluation recommended"
CONSIDER_IMMEDIATE_SAFETY = "Consider immediate safety assessment"
ASSESS_SUICIDE_RISK = "Assess suicide risk"
CONSIDER_ANTIDEPRESSANT_THERAPY = "Consider antidepressant therapy adjustment"
EVALUATE_NEED_FOR = "Evaluate need for mood stabilizers"
MONITOR_FOR_PSYCHOTIC = "Monitor for psychotic features"
CONSIDER_EMERGENCY_DEPARTMENT = "Consider emergency department evaluation"
SCHEDULE_PSYCHIATRIC_FOLLOW = "Schedule psychiatric follow-up within 1-2 weeks"
MONITOR_SYMPTOM_PROGRESSION = "Monitor symptom progression daily"
CONSIDER_PSYCHOTHERAPY_REFERRAL = "Consider psychotherapy referral"
ENCOURAGE_BEHAVIORAL_ACTIVATION = "Encourage behavioral activation"
MAINTAIN_REGULAR_SLEEP = "Maintain regular sleep schedule"
AVOID_STIMULANTS_AND = "Avoid stimulants and alcohol"
CONTINUE_CURRENT_MONITORING = "Continue current monitoring schedule"
MAINTAIN_HEALTHY_LIFESTYLE = "Maintain healthy lifestyle habits"
ENSURE_MEDICATION_ADHERENCE = "Ensure medication adherence if prescribed"
TRACK_MOOD_CHANGES = "Track mood changes using daily logs"

# Treatment approval
ANTIDEPRESSANT_MONOTHERAPY_IS = "Antidepressant monotherapy is contraindicated in bipolar disorder"
ANTIDEPRESSANT_ACCEPTABLE_WITH = "Antidepressant acceptable with mood stabilizer coverage"
LITHIUM_APPROVED_ENSURE = "Lithium approved - ensure regular monitoring of levels and renal function"
TREATMENT_WITHIN_CLINICAL = "Treatment within clinical guidelines"

# Basic features
SEVERE_SLEEP_DEPRIVATION = "Severe sleep deprivation"
HYPERSOMNIA_PATTERN = "Hypersomnia pattern"
HYPERACTIVITY_PATTERN = "Hyperactivity pattern"
HYPOACTIVITY_PATTERN = "Hypoactivity pattern"
ERRATIC_ACTIVITY_PATTERN = "Erratic activity pattern"
ELEVATED_RESTING_HEART = "Elevated resting heart rate"
LOW_HRV_INDICATES = "Low HRV indicates poor recovery"
ABNORMAL_HEART_RATE = "Abnormal heart rate circadian rhythm"

# Pattern notes
INSOMNIA_PATTERN_DETECTED = "Insomnia pattern detected: consistently short sleep duration"
HYPERSOMNIA_PATTERN_DETECTED_CONSISTENTLY = "Hypersomnia pattern detected: consistently long sleep duration"
IRREGULAR_SLEEP_PATTERN = "Irregular sleep pattern: high variability in sleep timing"
VERY_LOW_CIRCADIAN = "Very low circadian stability detected"

# validation
UNUSUALLY_LOW_SLEEP = "Unusually low sleep duration"
UNUSUALLY_HIGH_SLEEP = "Unusually high sleep duration"
UNUSUALLY_LOW_ACTIVITY = "Unusually low activity"
INSUFFICIENT_HISTORICAL_DATA = "Insufficient historical data for temporal features"

# Processing strategy
SPARSE_DATA_CONFIDENCE = "Sparse data - confidence intervals widened"
VERY_SPARSE_DATA = "Very sparse data - results may be unreliable"

# Data summary
NO_SLEEP_DATA = "no sleep data"
NO_ACTIVITY_DATA = "no activity data"
SPARSE_DATA = "sparse data"

# Episode steps
THE_MERGE_THRESHOLD = "the merge threshold must be positive"

# Overlap advice
USE_SENSOR_SPECIFIC = "Use sensor-specific analysis"
LIMITED_OVERLAP_USE = "Limited overlap - use with caution"
SUFFICIENT_OVERLAP_FOR = "Sufficient overlap for integrated analysis"

# report
ANALYSIS_PERIOD_DAYS = "Analysis Period: %d days"
DEPRESSION_RISK = "Depression Risk: "
HYPOMANIC_RISK = "Hypomanic Risk: "
MANIC_RISK = "Manic Risk: "
HIGH_DEPRESSION_RISK = "HIGH DEPRESSION RISK DETECTED"
MODERATE_DEPRESSION_RISK = "MODERATE DEPRESSION RISK"
LOW_DEPRESSION_RISK = "Low depression risk"
ELEVATED_MOOD_EPISODE = "ELEVATED MOOD EPISODE RISK"

# Texts of the early warning summary.
DETECTED = "detected"
DETECTED_PERSONALLY = "detected (using personalized thresholds)"
NO_WARNING_SIGNS = "No significant warning signs "
MIXED_WARNING_SIGNS = "Mixed warning signs "
BOTH_INDICATORS = " - both depression and mania indicators present"
DEPRESSION_WARNING_SIGNS = "Depression warning signs "
MANIA_WARNING_SIGNS = "Mania warning signs "
INTERVENE_NOW = ". Immediate clinical intervention recommended"
KEEP_MONITORING = ". Continued monitoring required"

# Notes of the diagnostic criteria and of the data validation.
ENOUGH_SYMPTOMS = "%d symptoms meets minimum requirement of %d"
TOO_FEW_SYMPTOMS = "Insufficient symptoms: %d < %d required"
IMPAIRMENT_IN = "Significant impairment in: "
NO_IMPAIRMENT = "No significant functional impairment documented"
NO_SLEEP_RECORDS = "No sleep records found"
NO_ACTIVITY_RECORDS = "No activity records found"
SPARSE_SLEEP = "Sparse sleep data: "
COVERAGE = "% coverage"
