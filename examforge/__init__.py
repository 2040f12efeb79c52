"""Assessment data on Spark: attempt analytics, quiz assembly, catalogues, text segmentation, quality checks, law corpora."""
