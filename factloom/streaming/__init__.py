"""The batch plans over streams of documents."""
