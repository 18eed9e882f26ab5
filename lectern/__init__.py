"""lectern: a Spark-native engine for collections of dated, attributed documents."""
