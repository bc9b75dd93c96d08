"""cellmill.streaming"""
