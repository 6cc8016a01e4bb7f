"""noticeflow: DataFrame operators for notices, documents and training text."""
