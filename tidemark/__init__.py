"""tidemark: campaign-response, send-time and message-text analytics as Spark plans."""
