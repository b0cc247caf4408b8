"""A Spark-native engine for covariances of angular power spectra seen through a mask."""
