"""talkloom: conversation-log analytics and training-data preparation on Spark."""
