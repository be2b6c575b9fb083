"""Spark-native numerical analytics and classical machine learning over DataFrames."""
