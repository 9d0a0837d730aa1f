"""Fleet-scale analysis of Windows host artefacts on Spark."""
