"""loamline: data curation, label triage, classifier evaluation and sensor series on Spark."""
