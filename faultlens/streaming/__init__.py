"""faultlens.streaming"""
