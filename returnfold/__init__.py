"""Return-series analytics and corpus operators as Spark jobs."""
